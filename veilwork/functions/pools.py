"""Small word pools that tokens and pseudonyms are drawn from (our own choice of words)."""

FIRST_NAMES = (
    "Aarav", "Aditi", "Amit", "Ananya", "Arjun", "Asha", "Bhavna", "Chetan", "Deepa", "Dev",
    "Divya", "Esha", "Farhan", "Gauri", "Harish", "Indira", "Ishaan", "Jaya", "Kabir", "Kavya",
    "Lata", "Manoj", "Meera", "Mohan", "Naina", "Nikhil", "Ojas", "Pooja", "Prakash", "Rahul",
    "Rekha", "Rohan", "Sana", "Sunil", "Tara", "Uday", "Varun", "Vidya", "Yash", "Zoya",
)
LAST_NAMES = (
    "Agarwal", "Bajaj", "Banerjee", "Bhat", "Chandra", "Chopra", "Das", "Desai", "Dutta", "Gandhi",
    "Ghosh", "Gupta", "Iyer", "Jain", "Joshi", "Kapoor", "Khan", "Kulkarni", "Kumar", "Malhotra",
    "Mehta", "Menon", "Mishra", "Nair", "Naidu", "Pandey", "Patel", "Pillai", "Rao", "Reddy",
    "Saxena", "Sethi", "Shah", "Sharma", "Singh", "Sinha", "Thakur", "Trivedi", "Varma", "Yadav",
)
CITIES = (
    "Agra", "Ajmer", "Bhopal", "Chennai", "Cuttack", "Dehradun", "Delhi", "Goa", "Guwahati", "Hyderabad",
    "Indore", "Jaipur", "Kanpur", "Kochi", "Kolkata", "Lucknow", "Mumbai", "Mysuru", "Nagpur", "Patna",
    "Pune", "Raipur", "Ranchi", "Shimla", "Surat", "Udaipur", "Vadodara", "Varanasi",
)
STATES = (
    "Andhra Pradesh", "Assam", "Bihar", "Chhattisgarh", "Goa", "Gujarat", "Haryana", "Himachal Pradesh",
    "Jharkhand", "Karnataka", "Kerala", "Madhya Pradesh", "Maharashtra", "Manipur", "Meghalaya", "Odisha",
    "Punjab", "Rajasthan", "Sikkim", "Tamil Nadu", "Telangana", "Tripura", "Uttar Pradesh", "West Bengal",
)
STREETS = (
    "Banyan Road", "Canal Street", "Garden Lane", "Hill Road", "Lake View", "Lotus Avenue", "Mango Street",
    "Market Road", "Neem Lane", "Park Street", "River Road", "Station Road", "Temple Street", "Tulip Lane",
)
WORDS = (
    "amber", "anchor", "basil", "birch", "cedar", "cloud", "coral", "delta", "ember", "fern",
    "field", "flint", "grove", "harbor", "hazel", "ivory", "juniper", "kite", "lagoon", "linen",
    "maple", "meadow", "mint", "north", "ocean", "olive", "opal", "pearl", "pine", "quartz",
    "raven", "reef", "river", "saffron", "slate", "spruce", "stone", "thistle", "tulip", "velvet",
    "violet", "walnut", "willow", "winter",
)
MAIL_DOMAINS = ("example.com", "example.net", "example.org")
