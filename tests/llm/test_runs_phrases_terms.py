"""Periodic runs, collocations and disclosure against plain Python, with awkward rows."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from veilwork.llm import collocations, disclosure, recompression, words

duckdb = pytest.importorskip("duckdb")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


# --- words and bit tables ---------------------------------------------------------------------------------------


def test_words_are_those_of_the_pattern():
    rng = random.Random(4)
    texts = ["".join(rng.choice("aé \t\n\x0b\x1c \U0001f389b") for _ in range(rng.randint(0, 30))) for _ in range(300)] + ["", None, "a", " "]
    column = pa.array(texts, pa.string())
    for part in (column, column.slice(7, 100)):
        got = words.words_of(part, words.SPACES)
        want = [(i, w) for i, t in enumerate(part.to_pylist()) for w in WORD.findall(t or "")]
        assert list(zip(got.row.tolist(), got.text.to_pylist(), strict=True)) == want
        assert [bytes(got.data[a:b]).decode() for a, b in zip(got.start, got.end, strict=True)] == [w for _, w in want]


def test_hashes_follow_the_string_alone():
    some = pa.array(["b", "", "ab", "a" * 50, "é"], pa.large_string())
    rest = pa.array(["zz", "ab", "é", "", "b", "a" * 50], pa.large_string()).slice(1)
    one = dict(zip(some.to_pylist(), words.hashes(some).tolist(), strict=True))
    assert one == dict(zip(rest.to_pylist(), words.hashes(rest).tolist(), strict=True))
    assert len(set(one.values())) == 5


def test_bit_tables_hold_their_slots(spark):
    chosen = [0, 1, 7, 8, 32767, 32768, 65535, 99999, (1 << 17) - 1]
    table = np.frombuffer(words.bit_table(spark.createDataFrame([(s,) for s in chosen], "slot long"), 17), np.uint8)
    assert np.flatnonzero(words.among(table, np.arange(1 << 17))).tolist() == chosen
    assert not any(words.bit_table(spark.createDataFrame([], "slot long"), 17))


# --- 13 periodic runs -------------------------------------------------------------------------------------------


def plain_runs(ws, repeats=4, least=6):
    found = {}
    for p in range(1, len(ws) // repeats + 1):
        i = 0
        while i + p < len(ws):
            j = i
            while j + p < len(ws) and ws[j] == ws[j + p]:
                j += 1
            if j + p - i >= max(least, repeats * p):
                found.setdefault((i, j + p - i), p)
            i = j + 1
    return sorted(((s, n, p) for (s, n), p in found.items()), key=lambda r: (r[0], r[2]))


def plain_collapse(ws, runs):
    gone = {i for s, n, p in runs for i in range(s + p, s + n)}
    return " ".join(w for i, w in enumerate(ws) if i not in gone)


def repetitive(rng):
    ws = []
    for _ in range(rng.randint(0, 6)):
        unit = [rng.choice("abcdef"[: rng.choice([1, 2, 6])]) for _ in range(rng.randint(1, 9))]
        ws += unit * rng.randint(1, 7)
        ws = ws[: len(ws) - rng.randint(0, 2)]
    return rng.choice([" ", "\n", " \t "]).join(ws)


@pytest.mark.parametrize("repeats, least", [(4, 6), (2, 2), (3, 10)])
def test_runs_equal_plain_search(repeats, least):
    rng = random.Random(repeats)
    for _ in range(150):
        texts = [repetitive(rng) for _ in range(rng.randint(1, 5))] + [None, ""][: rng.randint(0, 2)]
        runs, collapsed = recompression._runs_in(pa.array(texts, pa.string()), repeats, least)
        for text, found, left in zip(texts, runs.to_pylist(), collapsed.to_pylist(), strict=True):
            ws = WORD.findall(text or "")
            want = plain_runs(ws, repeats, least)
            if repeats == 2:  # a stretch of two periods may have two maximal periods; the grid meets them all
                want = [r for r in want]
            assert [(r["start"], r["length"], r["period"]) for r in found] == want
            assert left == plain_collapse(ws, want)


def test_extensions_of_a_grammar():
    rng = np.random.default_rng(2)
    for symbols in (np.tile([0, 1, 0, 0, 2], 200), np.zeros(700, np.int64), rng.integers(0, 2, 900)):
        text = np.concatenate([[-1], symbols, [-2], symbols[:300], [-3]]).astype(np.int64)
        a, b = rng.integers(0, len(text), 400), rng.integers(0, len(text), 400)
        a, b = a[a != b], b[a != b]
        for x, y, n in zip(a, b, recompression.Grammar(text).lce(a, b), strict=True):
            m = 0
            while x + m < len(text) and y + m < len(text) and text[x + m] == text[y + m]:
                m += 1
            assert n == m


def test_long_texts_and_clashing_columns(spark):
    rows = [(1, "x " * 60_000, 1), (1, "x " * 60_000, 1), (2, None, 2), (3, " ".join(f"w{i % 5000}" for i in range(40_000)), 3), (None, "a b " * 9, 4)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, runs int").withColumn("collapsed", F.lit("clash"))
    got = sorted(((r["doc_id"] or 0, [tuple(x) for x in r["runs"]], r["collapsed"][:20]) for r in recompression.find_runs(frame).collect()))
    first = " ".join(f"w{i}" for i in range(5000))[:20]
    assert got == [(0, [(0, 18, 2)], "a b"), (1, [(0, 60000, 1)], "x"), (1, [(0, 60000, 1)], "x"), (2, [], ""), (3, [(0, 40000, 5000)], first)]
    assert recompression.find_runs(frame.limit(0)).count() == 0


def test_op13_plants_and_digests(spark, data):
    import zlib

    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()}
    for r in recompression.op13_periodic_runs(spark, data).collect():
        ws = WORD.findall(texts[r["doc_id"]] or "")
        h, n = zlib.crc32(str(r["doc_id"]).encode()), len(ws)
        if h % 10 == 0 and n:
            a, p = h // 10 % n, 1 + (n - h // 10 % n) // (3 + h // 10 % 8)
            ws = [ws[i] if i < a else ws[a + (i - a) % p] for i in range(n)]
        if n > 4000:
            continue
        runs = plain_runs(ws)
        top = min(runs, key=lambda x: (-x[1], x[0], x[2])) if runs else (None, None, None)
        want = (r["doc_id"], len(runs), *top, 1000 * top[1] // top[2] if runs else None)
        listed = "".join(f"{s},{m},{p}\n" for s, m, p in runs)
        assert tuple(r) == (*want, *(hashlib.sha256(x.encode()).hexdigest() for x in (listed, plain_collapse(ws, runs))))


# --- 11 collocations --------------------------------------------------------------------------------------------


def plain_collocations(rows, support, longest, k):
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang, text = lang or "und", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", text):
            ws = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(ws)
            f.update((lang, *ws[i : i + m]) for m in range(1, longest + 1) for i in range(len(ws) - m + 1))
    out = []
    for key, a in f.items():
        lang, p = key[0], key[1:]
        if len(p) < 2 or a < support:
            continue
        if any(q[0] == lang and len(q) > len(key) and 100 * b >= 80 * a and any(q[i : i + len(p)] == p for i in range(1, len(q))) for q, b in f.items() if b >= support):
            continue
        cuts = [(2_000_000 * a // (f[(lang, *p[:c])] + f[(lang, *p[c:])]), c) for c in range(1, len(p))]
        score, c = min(cuts)
        out.append((lang, -score, -a, " ".join(p).encode(), f[(lang, *p[:c])], f[(lang, *p[c:])]))
    ranked, seen = [], Counter()
    for lang, score, a, phrase, left, right in sorted(out):
        seen[lang] += 1
        if seen[lang] <= k:
            ranked.append((lang, seen[lang], phrase.decode(), -a, left, right, n[lang], -score))
    return sorted(ranked)


@pytest.mark.parametrize("shards, bits", [(1, 15), (5, 22)])
def test_collocations_equal_plain_counts(spark, shards, bits):
    rng = random.Random(shards)
    some = ["New", "york", "city", "é", "the", "of", "Öl", "x y", "a.b", "\U0001f389"]
    rows = [(i, " ".join(rng.choice(some) + rng.choice(["", "", "", ",", "\n", "\t"]) for _ in range(rng.randint(0, 40))), rng.choice(["en", "de", None])) for i in range(150)]
    rows += [(i % 3, "one rare phrase here", "fr") for i in range(12)] + [(None, None, "fr"), (7, "", "it"), (8, "new york city " * 400, "en")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("shard", F.lit("clash")).withColumn("count", F.lit(1))
    got = collocations.collocations(frame, support=10, k=25, shards=shards, bits=bits).collect()
    assert sorted(map(tuple, got)) == plain_collocations([(r[2], r[1]) for r in rows], 10, 4, 25)


def test_no_documents_no_collocations(spark):
    assert collocations.collocations(spark.createDataFrame([], "doc_id long, text string, lang string")).count() == 0


def test_big_counts_stay_exact(spark):
    huge = 10**13
    frame = spark.createDataFrame([("en", 1, "a", huge), ("en", 1, "b", huge), ("en", 2, "a b", huge - 1)], "lang string, size int, phrase string, a long")
    assert [r["score"] for r in collocations.scored(frame).collect()] == [2_000_000 * (huge - 1) // (2 * huge)]


def test_op11_equals_its_sql(spark, data):
    found = sorted(tuple(r) for r in collocations.op11_collocations(spark, data).collect())
    connection = duckdb.connect()
    connection.execute(f"CREATE VIEW documents AS SELECT * FROM '{data}/documents.parquet'")
    assert found == sorted(connection.execute(collocations.OP11_SQL).fetchall())


# --- 12 disclosure ----------------------------------------------------------------------------------------------

KINDS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain_identifiers(text):
    found = []
    for rank, (kind, pattern) in enumerate(KINDS.items()):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            twice = sum(sum(divmod(int(d) * (1 + i % 2), 10)) for i, d in enumerate(reversed(digits)))
            fits = {
                "email": True, "ip": kind != "ip" or all(int(x) <= 255 for x in m[0].split(".")),
                "card": 12 <= len(digits) <= 19 and twice % 10 == 0, "phone": 9 <= len(digits) <= 15,
            }
            if fits[kind]:
                found.append((m.start(), rank, m.end()))
    return sorted(found)


def test_identifiers_equal_the_patterns():
    rng = random.Random(12)
    for _ in range(4000):
        text = "".join(rng.choice(["a@b.c", "1.2.3.4", "@", ".", "-", "+1", " ", "(", ")", "4111111111111111", "7", "99", "é", "x", "\n", "256", "007"]) for _ in range(rng.randint(0, 14)))
        assert disclosure.identifiers(text) == plain_identifiers(text), text
    assert disclosure.identifiers(None) == []
    assert disclosure.identifiers("a" * 500_000 + "1" * 500_000 + "@" * 500_000) == []
    assert disclosure.identifiers("1." * 3 + "9" * 5000) == []


def plain_terms(texts, share, support):
    """Sensitive terms by the definition, from the units of all texts."""
    units = []  # (entities, terms outside identifiers, all terms), by unit
    for text in texts:
        spans = plain_identifiers(text)
        for line in re.finditer(r"[^\n]+", text or ""):
            ws = list(re.finditer(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", line[0]))
            for i in range(0, len(ws), disclosure.UNIT_WORDS):
                at = [(w.start() + line.start(), w.end() + line.start(), w[0]) for w in ws[i : i + disclosure.UNIT_WORDS]]
                touched = [next(((s, k, e) for s, k, e in spans if a < e and b > s), None) for a, b, _ in at]
                own = set()
                for s, k, e in spans:
                    first = [j for j, (a, b, _) in enumerate(at) if a < e and b > s]
                    if first and not any(a < e and b > s for a, b, _ in [(w.start() + line.start(), w.end() + line.start(), 0) for w in ws[:i]]):
                        own.add(disclosure.entity(k, text[s:e]))
                lower = [re.sub("[A-Z]", lambda m: m[0].lower(), w) for _, _, w in at]
                units.append((own, frozenset(w for w, t in zip(lower, touched, strict=True) if t is None), frozenset(lower), tuple(lower)))
    n = len(units)
    n_t = Counter(t for u in units for t in u[2])
    by_entity = defaultdict(list)
    for u in units:
        for c in u[0]:
            by_entity[c].append(u)
    out = set()
    for us in by_entity.values():
        for t in {t for u in us for t in u[1]}:
            with_t = [u for u in us if t in u[1]]
            told = math.log2(n * len(with_t) / (len(us) * n_t[t])) / math.log2(n / len(us)) if len(us) < n else 0
            if len({u[3] for u in with_t}) >= support and told >= share - 1e-9:
                out.add(t)
    return out


@pytest.fixture(scope="module")
def private(spark):
    rng = random.Random(9)
    some = [f"word{chr(97 + i)}" for i in range(20)]
    prose = lambda n: " ".join(rng.choice(some) for _ in range(n))
    texts = [prose(40) + "\n" + prose(12) for _ in range(120)]
    texts += [f"{prose(6)} Zanzibar office ann.lee@mail.example.org {prose(5)}\n{prose(20)}" for _ in range(6)]
    texts += [f"é {prose(3)} call +1 (017) 555-7713 agent x7k9 {prose(3)}" for _ in range(5)]
    texts += ["one copied line with bob@x.example.com unusual"] * 9  # one unit, however often
    texts += ["Went to Zanzibar. \U0001f389 zanzibar", "card 4111 1111 1111 1111, host 10.0.0.255", "", None]
    rows = [(i, t, "clash") for i, t in enumerate(texts)] + [(5, texts[5], "clash"), (None, "x7k9 again", "clash")]
    return spark.createDataFrame(rows, "doc_id long, text string, spans string")


def test_sensitive_terms_equal_plain_counts(private):
    texts = [r["text"] for r in private.collect()]
    got = {r["term"]: r["action"] for r in disclosure.sensitive_terms(private, support=3).collect()}
    assert set(got) == plain_terms(texts, disclosure.DISCLOSURE, 3)
    assert {"zanzibar", "x7k9"} <= set(got) and "unusual" not in got and not any(t.startswith("word") for t in got)


def test_spans_cover_identifiers_and_terms_everywhere(private):
    terms = {r["term"] for r in disclosure.sensitive_terms(private).collect()}
    found = disclosure.sanitise(private, keep=("doc_id", "text"))
    rows = found.withColumn("clean", disclosure.replaced(F.col("text"), F.col("spans"))).collect()
    assert len(rows) == private.count()
    for r in rows:
        text = r["text"] or ""
        base = plain_identifiers(text)
        words_ = re.finditer(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text)
        more = [(m.start(), 4, m.end()) for m in words_ if m[0].lower() in terms and not any(m.start() < e and m.end() > s for s, _, e in base)]
        assert [(s["start"], s["rank"], s["end"]) for s in r["spans"]] == sorted(base + more)
        assert (r["clean"] is None) == (r["text"] is None)
        assert not plain_identifiers(r["clean"]) and "anzibar" not in (r["clean"] or "")


def test_nothing_to_sanitise(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert disclosure.sanitise(empty).count() == 0
    assert [len(r["spans"]) for r in disclosure.sanitise(spark.createDataFrame([(1, None), (2, "plain text")], "doc_id long, text string")).collect()] == [0, 0]


def test_op12_counts_and_digests(spark, data):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()}
    for r in disclosure.op12_disclosure(spark, data).collect():
        base = plain_identifiers(texts[r["doc_id"]])
        said = [f"{list(KINDS)[k]}:{s}:{e}" for s, k, e in base]
        assert [r[f"n_{k}"] for k in KINDS] == [sum(1 for b in base if b[1] == i) for i in range(4)]
        assert r["base_sha256"] == hashlib.sha256(",".join(said).encode()).hexdigest()
        assert [s for s in r["spans"].split(",") if s and not s.startswith("term:")] == said


def test_local_counts_are_narrow_rows(spark):
    """A shuffled row of a local count is three numbers; every shard and language counts by itself."""
    from veilwork.llm import collocations

    rows = [("a b a", "en", 0), ("a", "en", 2), ("a b", None, 2), ("b", "en", 0)]
    docs = spark.createDataFrame(rows, "text string, lang string, shard int")
    found = collocations.local_counts(docs, [], 16, 3)
    assert found.columns == ["cell", "key", "count"]
    got = found.collect()
    assert sorted((r["cell"] & 3, r["count"]) for r in got) == [(0, 2), (0, 2), (2, 1), (2, 1), (2, 1)]
    assert len({r["cell"] for r in got}) == 3 and len({r["cell"] >> 2 for r in got}) == 2
