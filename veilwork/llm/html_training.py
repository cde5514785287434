"""Labelled pages from which the extraction model learns.

``data-keep="1"`` marks an element of the main text, ``"0"`` one that is not;
children follow their parent until they are marked themselves.  The pages are
written for this purpose, with the structures and names that are usual on news
sites, blogs, forums, shops and documentation.
"""

_TEXT = (
    "The committee met on Tuesday to discuss the plan for the new bridge, and most members agreed that it was late.",
    "After a long debate, the engineers explained why the first design had failed; nobody had measured the river.",
    "Short note.",
    "In the second year, costs rose by twelve percent. The town could pay for that, but only with help from others.",
    "She walked home, thinking about what had been said, and wrote it all down before the evening was over.",
)
_LINKS = "".join(f'<li><a href="/{w}">{w}</a></li>' for w in ("Home", "News", "Sports", "Contact", "About us"))
_MENU = f'<nav data-keep="0"><ul>{_LINKS}</ul></nav>'
_FOOT = '<footer data-keep="0">&copy; 2020 Example Press &middot; All the small print that nobody reads.</footer>'
_P = "".join(f"<p>{t}</p>" for t in _TEXT)
_LIST = f"<ul><li>{_TEXT[3]}</li><li>{_TEXT[2]}</li></ul>"
_AD = f'<div class="ad" data-keep="0">{_TEXT[0]}</div>'

PAGES = [
    f'<html><body data-keep="0">{_MENU}{_AD}<article data-keep="1"><h1>A bridge</h1>{_P}</article>{_FOOT}</body></html>',
    f'<html><body data-keep="0"><header><h1>Example Press</h1><p>Since 1900.</p></header>{_MENU}<main data-keep="1"><h2>Late again</h2>{_P}{_LIST}</main>'
    f'<aside data-keep="0"><h3>Most read</h3><ul>{_LINKS}</ul><p>{_TEXT[4]}</p></aside>{_FOOT}</body></html>',
    f'<html><body data-keep="0"><div class="navbar menu"><ul>{_LINKS}</ul></div><div id="content" data-keep="1"><h1>Title</h1>{_P}<blockquote>{_TEXT[1]}</blockquote></div>'
    f'<div id="sidebar" class="widget" data-keep="0"><p>{_TEXT[3]}</p><ul>{_LINKS}</ul></div><div id="footer" data-keep="0"><p>{_TEXT[2]}</p></div></body></html>',
    f'<html><body data-keep="0"><div class="cookie-banner notice consent" data-keep="0"><p>We use cookies. {_TEXT[0]}</p></div><div class="post-content entry-content" data-keep="1">{_P}<pre>x = 1</pre></div>'
    f'<div id="comments" class="comments" data-keep="0"><h3>Comments</h3><div class="comment"><p>{_TEXT[4]}</p></div><div class="comment reply"><p>{_TEXT[1]}</p></div></div></body></html>',
    f'<html><body data-keep="0">{_MENU}<article data-keep="1"><header><h1>In its own header</h1></header>{_P}<div class="share social" data-keep="0"><a href="#">Share</a></div>'
    f'<div class="advert sponsored promo" data-keep="0"><p>{_TEXT[1]}</p></div><p>{_TEXT[4]}</p><section class="comments" data-keep="0"><p>{_TEXT[0]}</p></section>'
    f'<form class="newsletter subscribe" data-keep="0"><p>{_TEXT[3]}</p><label>Mail</label></form></article>{_FOOT}</body></html>',
    f'<html><body data-keep="0"><div class="header masthead" data-keep="0"><p>{_TEXT[0]}</p></div><div class="article-body story" data-keep="1"><h1>Head</h1>{_P}<table><tr><td>Year</td><td>Cost in full</td></tr></table></div>'
    f'<div class="related recommended" data-keep="0"><h3>More</h3><p><a href="#">{_TEXT[1]}</a></p></div>{_FOOT}</body></html>',
    f'<html><body data-keep="0">{_MENU}<section id="main-content" data-keep="1"><h1>Doc</h1>{_P}<dl><dt>Term</dt><dd>{_TEXT[1]}</dd></dl><figure><figcaption>{_TEXT[2]}</figcaption></figure></section>'
    f'<form data-keep="0"><p>Search the site for what you need.</p><fieldset><legend>Login</legend></fieldset></form>{_FOOT}</body></html>',
    f'<html><body data-keep="0"><ul class="breadcrumb" data-keep="0">{_LINKS}</ul><article class="post" data-keep="1"><h2>Post</h2><div>{_P}</div><div>{_TEXT[0]}</div></article>'
    f'<aside class="sidebar" data-keep="0"><p>{_TEXT[0]}</p><div><p>{_TEXT[3]}</p></div></aside><div role="alert" class="alert notice" data-keep="0"><p>{_TEXT[1]}</p></div></body></html>',
    f'<html><body data-keep="0"><article data-keep="1">{_TEXT[0]}<p>{_TEXT[2]}</p><ol><li>{_TEXT[4]}</li><li>Two words</li></ol>{_P}</article><div class="ads banner" data-keep="0">{_TEXT[3]}</div></body></html>',
    f'<html><body data-keep="0"><div class="wrapper"><div class="container"><main data-keep="1"><article><h1>Nested</h1>{_P}</article></main></div></div><div class="popup modal" data-keep="0"><p>{_TEXT[4]}</p></div>{_FOOT}</body></html>',
    f'<html><body data-keep="1"><h1>Plain page</h1>{_P}{_LIST}</body></html>',
    f'<html><body data-keep="1">{_TEXT[1]}<p>{_TEXT[4]}</p><p>{_TEXT[2]}</p><div data-keep="0" class="footer">{_TEXT[3]}</div></body></html>',
    f'<html><body data-keep="0">{_MENU}<article data-keep="1"><h1>With ads</h1><p>{_TEXT[0]}</p><div class="ad" data-keep="0">{_TEXT[1]}</div><p>{_TEXT[2]}</p><aside data-keep="0"><p>{_TEXT[4]}</p></aside><nav data-keep="0"><p>{_TEXT[3]}</p></nav>'
    f'<footer data-keep="0"><p>{_TEXT[1]}</p></footer></article>{_FOOT}</body></html>',
    f'<html><body data-keep="1"><p>{_TEXT[0]}</p><h2>Only text</h2>{_P}</body></html>',
    f'<html><body data-keep="1">{_TEXT[0]}<ul data-keep="0" class="links"><li><a href="#">Elsewhere</a></li></ul><p>{_TEXT[1]}</p>{_AD}</body></html>',
    f'<html><body data-keep="1"><div class="menu" data-keep="0"><ul>{_LINKS}</ul></div><div>{_P}</div><div>{_TEXT[4]}</div><div class="copyright" data-keep="0">{_TEXT[2]}</div></body></html>',
    f'<html><body data-keep="0"><header data-keep="0"><h1>Site name</h1><p>{_TEXT[2]}</p></header><div class="main"><div class="text" data-keep="1"><h1>Inner</h1>{_P}{_LIST}<div class="gallery">{_TEXT[3]}</div>'
    f'<div class="sponsor advertisement" data-keep="0"><p>{_TEXT[0]}</p></div><div class="comment-list disqus" data-keep="0"><ol><li><p>{_TEXT[1]}</p></li></ol></div></div></div>{_FOOT}</body></html>',
    f'<html><body data-keep="0"><div id="top"><div class="logo">{_TEXT[2]}</div></div><article data-keep="1"><div class="body"><h1>Deep</h1>{_P}</div><aside class="pullout related" data-keep="0"><p>{_TEXT[3]}</p></aside>'
    f'<form data-keep="0"><p>{_TEXT[4]}</p></form></article><section id="comments" data-keep="0"><article class="comment"><p>{_TEXT[0]}</p></article><article class="comment"><p>{_TEXT[1]}</p></article></section>{_FOOT}</body></html>',
    # no names, no sections that say what they are
    f'<html><body data-keep="1"><div><div>{_P}</div></div></body></html>',
    f'<html><body data-keep="0"><nav><ul>{_LINKS}</ul></nav><p data-keep="1">{_TEXT[0]}</p><p data-keep="1">{_TEXT[1]}</p><footer><p>{_TEXT[2]}</p></footer></body></html>',
    f'<html><body data-keep="0"><nav><ul>{_LINKS}</ul></nav><div data-keep="1"><p>{_TEXT[0]}</p></div></body></html>',
    f'<html><body data-keep="0"><div><ul>{_LINKS}</ul></div><div data-keep="1"><h2>Named by nothing</h2>{_P}</div><div><a href="#">Imprint</a> <a href="#">Terms of use</a></div></body></html>',
    f'<html><body data-keep="0"><div><a href="/">Home</a> <a href="/a">All news</a></div><div data-keep="1"><div><p>{_TEXT[3]}</p><p>{_TEXT[1]}</p></div></div></body></html>',
    # layout tables
    f'<html><body data-keep="0"><table><tr><td><a href="/">Home</a><br><a href="/n">News</a></td><td data-keep="1"><p>{_TEXT[0]}</p><p>{_TEXT[4]}</p></td></tr></table></body></html>',
    f'<html><body data-keep="0"><table><tr><td><ul>{_LINKS}</ul></td><td data-keep="1">{_TEXT[1]} {_TEXT[0]}</td></tr><tr><td><a href="#">Back to the top</a></td></tr></table></body></html>',
    f'<html><body data-keep="0"><table><tr><td><a href="/">Start</a></td><td data-keep="1">{_TEXT[3]}</td></tr></table></body></html>',
    f'<html><body data-keep="0"><table><tr><td><a href="/">Start</a> <a href="/b">Next</a></td></tr><tr><td data-keep="1">{_TEXT[4]}<p>{_TEXT[0]}</p></td></tr></table></body></html>',
    f'<html><body data-keep="0"><center data-keep="1"><h1>Old page</h1>{_TEXT[3]}<p>{_TEXT[1]}</p></center><table><tr><td><a href="/">Home</a></td></tr></table></body></html>',
    # comment lists, forums, shops
    f'<html><body data-keep="0"><div data-keep="1"><h1>With replies</h1>{_P}</div><ol class="commentlist" data-keep="0"><li class="comment"><p>{_TEXT[4]}</p></li><li class="comment reply"><p>{_TEXT[0]}</p></li></ol></body></html>',
    f'<html><body data-keep="0"><article data-keep="1"><h1>Blog</h1>{_P}</article><ul class="commentlist comments" data-keep="0"><li><p>{_TEXT[1]}</p></li></ul><section class="responses comments" data-keep="0"><p>{_TEXT[3]}</p></section></body></html>',
    f'<html><body data-keep="0">{_MENU}<div class="thread" data-keep="1"><div class="post"><p>{_TEXT[0]}</p></div><div class="post"><p>{_TEXT[1]}</p></div></div>{_FOOT}</body></html>',
    f'<html><body data-keep="0">{_MENU}<div class="product" data-keep="1"><h1>A kettle</h1><p>{_TEXT[3]}</p><ul><li>{_TEXT[2]}</li></ul></div><div class="related products" data-keep="0"><a href="#">Cup</a> <a href="#">Pot</a></div>{_FOOT}</body></html>',
]
