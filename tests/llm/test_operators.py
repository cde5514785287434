"""The training-data operators against brute force, exact round trips and their SQL, with awkward rows."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from veilwork.llm import bpe, html_text, langid, licenses, lines, minhash, mixing, quality, stages, suffixes, topk
from veilwork.llm.components import components
from veilwork.llm.shared import BATCH_BYTES, small_batches

DOCS = "doc_id long, text string, lang string, source string, extra string"
WORDS = [f"w{i}" for i in range(400)]


def prose(seed: int, n: int) -> str:
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="module")
def docs(spark):
    base = prose(1, 300)
    near = base.replace(base.split()[150], "changed", 1)
    passage = prose(2, 80)
    rows = [
        (1, base, "en", "a", "x"),
        (2, base, "en", "a", "x"),
        (3, near, "en", "b", None),
        (4, None, "en", None, "x"),
        (5, "", None, "b", "x"),
        (6, prose(3, 100) + passage + prose(4, 60), "en", "c", "x"),
        (7, passage + "\nshort\nshort\n" + prose(5, 30), "en", "c", "x"),
        (8, prose(6, 9000), "en", "c", "x"),
        (9, "a a a a a a a a a a a a\n\n \nthe line number 100 is here\nthe line number 101 is here", "en", "a", "x"),
        (10, "Licensed under CC BY-NC 4.0.\nAll rights reserved cc--by", "en", "b", "x"),
        (10, "Licensed under CC BY-NC 4.0.\nAll rights reserved cc--by", "en", "b", "x"),
        (11, "ääö ñé　x 123 \U0001f389 \x0b y", "de", "b", "x"),
        (12, "z", "en", "b", "x"),
    ]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], DOCS)


def pairs_of(docs):
    return [(r["doc_id"], r["text"] or "") for r in docs.collect()]


# --- 1 byte-level BPE -------------------------------------------------------------------------------------------


def test_bpe_equals_the_public_library(docs):
    tiktoken = pytest.importorskip("tiktoken")
    ranks, pattern = bpe.vocabulary()
    known = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=bpe.parse_ranks(ranks), special_tokens={})
    for r in bpe.encode(docs.select("doc_id", "text", "extra"), ranks, pattern, keep=("doc_id", "text")).collect():
        text = r["text"] or ""
        assert r["ids"] == known.encode_ordinary(text)
        assert r["n_tokens"] == len(r["ids"])
        assert bytes(r["decoded"]) == text.encode()
        assert r["ids_sha256"] == hashlib.sha256(" ".join(map(str, r["ids"])).encode()).hexdigest()


def test_both_trees_merge_alike_and_long_runs_work():
    ranks, pattern = bpe.vocabulary()
    code = bpe.ByteBPE(bpe.parse_ranks(ranks))
    rng = random.Random(3)
    pieces = ["".join(rng.choice("abcdeinorst é") for _ in range(rng.randint(2, 40))).encode() for _ in range(300)]
    assert code.merge(pieces) == [code.merge_one(p) for p in pieces]
    tiktoken = pytest.importorskip("tiktoken")
    known = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=bpe.parse_ranks(ranks), special_tokens={})
    long = "ab" * 30_000 + " " * 3000 + "x y " * 60_000
    assert list(bpe.Coder(code, pattern).rows([long], ("ids",))[0][0]) == known.encode_ordinary(long)


def test_decode_round_trip(docs):
    ranks, pattern = bpe.vocabulary()
    coded = bpe.encode(docs, ranks, pattern, keep=("doc_id", "text"), outputs=("ids",))
    assert all(bytes(r["decoded"]) == (r["text"] or "").encode() for r in bpe.decode(coded, ranks, ("doc_id", "text")).collect())


def task_of(monkeypatch, make):
    """What a frame sends to Python and the function that gets it, by batches in this process."""
    got = {}
    with monkeypatch.context() as m:
        m.setattr("pyspark.sql.classic.dataframe.DataFrame.mapInArrow", lambda self, run, schema: got.update(sent=self, run=run) or self)
        make()
    return got["sent"], lambda: list(got["run"](got["sent"].toArrow().to_batches()))


def test_a_task_leaves_no_pieces_and_pieces_share_their_ids(docs, monkeypatch):
    ranks, pattern = bpe.vocabulary()
    _, run = task_of(monkeypatch, lambda: bpe.encode(docs, ranks, pattern, outputs=("ids",)))
    assert sum(b.num_rows for b in run()) == docs.count()
    assert bpe._CODERS and not any(c.known for c in bpe._CODERS.values())
    code = bpe.ByteBPE(bpe.parse_ranks(ranks))
    pieces = [b"qzxjv%d" % i for i in range(1000, 1100)]
    for made in (code.merge(pieces), [code.merge_one(p) for p in pieces]):
        ids = [i for piece in made for i in piece]
        assert max(ids) > 256 and len(set(map(id, ids))) == len(set(ids))


@pytest.mark.parametrize("make", [lambda d: bpe.encode(d, *bpe.vocabulary()), lambda d: langid.identify(d, None)])
def test_batches_of_long_texts_hold_few_rows(spark, make):
    long = spark.range(0, 30, 1, 1).select(F.col("id").alias("doc_id"), F.repeat(F.lit("word "), 100_000).alias("text"))
    before = spark.conf.get(BATCH_BYTES, None)
    try:
        spark.conf.unset(BATCH_BYTES)
        make(long)

        def rows(batches):
            import pyarrow as pa

            for b in batches:
                yield pa.RecordBatch.from_arrays([pa.array([b.num_rows], pa.int64())], names=["n"])

        sizes = [r["n"] for r in long.mapInArrow(rows, "n long").collect()]
        assert sum(sizes) == 30 and max(sizes) < 12
        spark.conf.set(BATCH_BYTES, "7m")
        assert small_batches(spark).conf.get(BATCH_BYTES) == "7m"
    finally:
        spark.conf.set(BATCH_BYTES, before) if before else spark.conf.unset(BATCH_BYTES)


# --- 2 exact top-k ----------------------------------------------------------------------------------------------


def test_topk_is_exact_with_ties_and_bad_vectors(spark):
    rng = np.random.default_rng(5)
    rows = [(i, [float(v) for v in rng.normal(size=6)]) for i in range(400)]
    rows += [(1000 + i, [0.5] * 6) for i in range(300)]
    rows += [(2000, None), (2020, [float("nan")] * 6), (2040, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (2060, [1.0, 2.0]), (2080, []), (None, [0.1] * 6)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("dims", F.lit("clash"))
    found = {}
    for r in topk.top_k(frame, F.col("vec_id") % 20 == 0, k=7, block_rows=150, chunk_rows=10).collect():
        found.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    whole = [(i, [int(np.floor(64 * x)) for x in v]) for i, v in rows if i is not None and v and len(v) == 6 and all(x is not None and x == x for x in v)]
    for q, v in whole:
        if q % 20 == 0:
            best = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), i) for i, w in whole if i != q)[:7]
            assert sorted(found[q]) == [(k + 1, i, -s) for k, (s, i) in enumerate(best)]
    assert set(found) == {q for q, _ in whole if q % 20 == 0}


# --- 3 suffix-array dedup ---------------------------------------------------------------------------------------


def brute_repeats(rows, size):
    seen = Counter(t.encode()[i : i + size] for _, t in rows for i in range(len(t.encode()) - size + 1))
    out = []
    for doc_id, t in rows:
        raw = t.encode()
        cut = bytearray(len(raw))
        for i in range(len(raw) - size + 1):
            if seen[raw[i : i + size]] > 1:
                cut[i : i + size] = b"\1" * size
        left = bytes(b for b, c in zip(raw, cut, strict=True) if not c)
        spans = sum(1 for i, c in enumerate(cut) if c and (i == 0 or not cut[i - 1]))
        out.append((doc_id, len(raw), len(raw) - len(left), spans, hashlib.sha256(left).hexdigest()))
    return sorted(out)


def test_suffix_dedup_equals_brute_force(spark, docs):
    rows = pairs_of(docs)
    shared = prose(70, 60)
    rows += [(100 + i, prose(200 + i, 40) + " " + shared + " " + prose(300 + i, 40)) for i in range(30)]
    rows += [(200, "ab" * 400), (201, "x" * 500), (202, "é" * 300 + prose(9, 50) + "é" * 300)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").withColumn("gram", F.lit(1))
    found = sorted(tuple(r) for r in suffixes.drop_repeats(frame).drop("kept").collect())
    assert found == brute_repeats(rows, 200)


def test_no_task_gets_a_whole_hot_gram(spark, monkeypatch):
    passage = prose(71, 40)[:150]  # shorter than a window: a part of many windows, most of them different
    rows = [(i, prose(500 + i, 40) + " " + passage + " " + prose(600 + i % 35, 40)) for i in range(60)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    sorted_runs, most = suffixes.sorted_runs, []

    def seen(texts, size, parts):
        by_gram = texts.select(F.explode("wanted").alias("w")).groupBy("w.gram").count()
        most.append(by_gram.agg(F.max("count")).first()[0] or 0)
        return sorted_runs(texts, size, parts)

    monkeypatch.setattr(suffixes, "sorted_runs", seen)
    monkeypatch.setattr(suffixes, "HOT", 10, raising=False)
    found = sorted(tuple(r) for r in suffixes.drop_repeats(frame).drop("kept").collect())
    assert found == brute_repeats(rows, 200)
    assert most[0] <= 10 and any(r[2] for r in found)


def test_loser_tree_merges_and_counts_shared_prefixes():
    rng = random.Random(8)
    every = [bytes(rng.choice(b"ab") for _ in range(rng.randint(1, 30))) for _ in range(500)]
    runs = [suffixes.front_code(sorted((s, b"l", i) for i, s in enumerate(every[k::7]))) for k in range(7)]
    merged = list(suffixes.LoserTree(runs))
    assert [m[1] for m in merged] == sorted(every)
    for a, b in zip(merged, merged[1:], strict=False):
        assert b[0] == suffixes.common(a[1], b[1])


# --- 4 MinHash near-dedup ---------------------------------------------------------------------------------------


def brute_components(rows, words, percent):
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t))
        n = min(words, len(w))
        sets[i] = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if w else set()
    parent = {i: i for i in sets}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return sorted((i, len(sets[i]), find(i)) for i in sets)


def test_minhash_equals_brute_force(spark, docs):
    rows = sorted(set(pairs_of(docs)))
    base = prose(50, 120).split()
    rng = random.Random(4)
    for i in range(60):  # a group of near copies, and chains through it
        w = list(base)
        for _ in range(rng.randint(0, 6)):
            w[rng.randrange(len(w))] = rng.choice(WORDS)
        rows.append((1000 + i, " ".join(w)))
    frame = spark.createDataFrame(rows, "doc_id long, text string").withColumn("component_id", F.lit("clash"))
    found = sorted(tuple(r) for r in minhash.near_duplicates(frame, words=3, percent=85).collect())
    assert found == brute_components(rows, 3, 85)


def test_components_of_chains(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 101), (103, 100), (200, 200)]
    found = dict(tuple(r) for r in components(spark.createDataFrame(links, "a long, b long")).collect())
    assert found == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 103: 100}


# --- 5 line dedup -----------------------------------------------------------------------------------------------


def test_banded_distance_equals_levenshtein(spark):
    rng = random.Random(1)
    rows = []
    for _ in range(800):
        b = [rng.choice("abé") for _ in range(rng.randint(1, 20))]
        a = list(b)
        for _ in range(rng.randint(0, 4)):
            rng.choice((lambda: a.insert(0, "b"), lambda: a.append("a"), lambda: a.__setitem__(rng.randrange(len(a)), "é")))()
        rows.append(tuple(sorted(("".join(a), "".join(b)), key=len, reverse=True)))
    frame = spark.createDataFrame(rows, "a string, b string")
    for edits in (1, 2, 3):
        measured = frame.where(F.length("a") - F.length("b") <= edits).select(
            lines.banded_distance(F.col("a"), F.col("b"), edits).alias("d"), F.levenshtein("a", "b").alias("w")
        )
        assert measured.count() > 100
        assert measured.where(((F.col("w") <= edits) & (F.col("d") != F.col("w"))) | ((F.col("w") > edits) & (F.col("d") <= edits))).count() == 0


@pytest.mark.parametrize("edits", [1, 2])
def test_line_dedup_equals_brute_force(spark, docs, edits):
    rng = random.Random(edits)
    rows = sorted(set(pairs_of(docs)))
    pool = [prose(400 + i, rng.randint(3, 12)) for i in range(12)]
    for i in range(40):
        cut = []
        for line in rng.sample(pool, 4):
            c = list(line)
            for _ in range(rng.randint(0, 2)):
                k = rng.randrange(len(c))
                c[k : k + rng.randint(0, 1)] = rng.choice(["", "q", "é"])
            cut.append("".join(c))
        rows.append((3000 + i, "\n".join(cut)))
    frame = spark.createDataFrame(rows, "doc_id long, text string").withColumn("place", F.lit(0))
    found = {r["doc_id"]: r["text"] for r in lines.dedup_lines(frame, edits=edits).collect()}

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    first = {}
    for doc_id, text in sorted(rows):
        for place, line in enumerate(text.split("\n")):
            if not re.fullmatch(r"[\x20\x09-\x0D]*", line):
                first.setdefault(line, (doc_id, place))
    fuzzy = [x for x in first if 12 <= len(x) < 500]
    near = {a: [first[b] for b in fuzzy if a != b and abs(len(a) - len(b)) <= edits and distance(a, b) <= edits] for a in fuzzy}
    for doc_id, text in rows:
        kept = [x for k, x in enumerate(text.split("\n")) if x not in first or (first[x] == (doc_id, k) and not any(o < first[x] for o in near.get(x, ())))]
        assert (found[doc_id] or "") == "\n".join(kept), doc_id
    assert sum(map(len, near.values()))


# --- 6 HTML extraction ------------------------------------------------------------------------------------------


def test_html_blocks_and_boilerplate(spark):
    t = "The committee met on Tuesday, and most members agreed that it was late."
    pages = {
        f"<nav><ul><li><a href=x>Home</a></li></ul></nav><article><h1>A &amp; B</h1><p><b>{t}<br><p>x&nbsp; y\n z<script>'<p>no'</script></article><footer>f</footer>": f"A & B\n\n{t}\n\nx y z",
        f"<article><p>{t}</p><aside><p>side</p></aside><div class='ad'>AD</div><form><p>form</p></form><ul><li>one<li>two</ul></article>": f"{t}\n\none\n\ntwo",
        f"<main><p>{t}</p><div class='comments'><div class='comment'><p>{t}</p></div></div></main><div class='cookie-notice'>c</div>": t,
        f"<p>{t}</p><p>b</p>": f"{t}\n\nb",
        "": "",
        "<p": "",
        "<div>" * 5000 + "x": "",
    }
    rows = [(i, "u", h, "x") for i, h in enumerate(pages)] + [(99, "u", None, "x")]
    out = html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string"))
    found = {r["page_id"]: (r["text"], r["n_chars"]) for r in out.collect()}
    assert found == {**{i: (t, len(t)) for i, t in enumerate(pages.values())}, 99: ("", 0)}


def test_deep_pages_keep_their_structure():
    page = "<div><article>" + "<div>" * 5000 + "x" + "</div>" * 5000 + "<section>after</section></article><nav>n</nav>"
    blocks = html_text.in_order(html_text.parse(page))
    above = {b.tag: b.parent.tag for b in blocks if b.tag in ("section", "nav", "article")}
    assert above == {"article": "div", "section": "article", "nav": "div"} and len(blocks) == 5005
    html_text.parse("<blockquote>" * 50_000 + "</p></div><td>" * 50_000)


def test_messages_equal_enumeration():
    """Sum-product on a small tree against summing over all states."""
    model = html_text.train()
    blocks = html_text.in_order(html_text.parse("<div><p>a<p>b</div><nav><ul><li>x</ul></nav>"))
    odds = html_text.marginals(blocks, model)
    place = {id(b): i for i, b in enumerate(blocks)}
    mass = np.zeros((len(blocks), 2))
    for bits in range(1 << len(blocks)):
        y = [bits >> i & 1 for i in range(len(blocks))]
        p = 1.0
        for i, b in enumerate(blocks):
            own = sum(model.ratios.get(f, 0.0) for f in html_text.features(b)) + (model.root if i == 0 else 0)
            p *= np.exp(own * y[i])
            if b.parent is not None:
                p *= model.child[html_text.kind(b)][y[place[id(b.parent)]]][y[i]]
        for i in range(len(blocks)):
            mass[i, y[i]] += p
    for i, b in enumerate(blocks):
        assert odds[id(b)] == pytest.approx(np.log(mass[i, 1] / mass[i, 0]))


# --- 7 license scans, 8 quality rules ---------------------------------------------------------------------------


def test_license_scan(docs):
    found = {r["doc_id"]: r for r in licenses.scan_licenses(docs).collect()}
    r = found[10]
    assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"]) == (12, 3, 2, 10)
    assert r["base_labels"] == ["cc-by", "reserved"] and r["labels"] == ["cc-by", "cc-by-nc", "reserved"] and r["score"] == 1.0
    assert found[4]["n_words"] == 0 and found[4]["labels"] == [] and found[4]["first_word"] is None and found[4]["score"] == 0


def test_license_join_equals_containment(spark):
    rng = random.Random(2)
    sets = licenses._template_words(licenses.TEMPLATES)
    rows = []
    for i in range(200):
        name = rng.choice(sorted(sets))
        w = [x for x in sets[name] if rng.random() < 0.85] + rng.sample(WORDS, 5)
        rng.shuffle(w)
        rows.append((i, " ".join(w)))
    found = {(r["doc_id"], r["label"]) for r in licenses.template_matches(spark.createDataFrame(rows, "doc_id long, text string"), licenses.TEMPLATES).collect()}
    assert found == {(i, k) for i, t in rows for k, w in sets.items() if len(set(w) & set(t.split())) >= 0.8 * len(w) - 1e-9}


def test_wrapped_notices_are_found(spark):
    import textwrap

    rows = []
    for width in (20, 40, 80):
        for name, notice in licenses.TEMPLATES.items():
            wrapped = textwrap.fill(notice, width, initial_indent=" * ", subsequent_indent=" * ")
            rows.append((len(rows), name, f"{prose(len(rows), 9)}\n\n{wrapped}\n{prose(len(rows) + 50, 9)}"))
    frame = spark.createDataFrame(rows, "doc_id long, name string, text string")
    found = {(r["doc_id"], r["label"]) for r in licenses.template_matches(frame, licenses.TEMPLATES).collect()}
    assert {(i, name) for i, name, _ in rows} <= found


def test_text_stats_equal_plain_python(docs):
    for r in quality.text_stats(docs).collect():
        text = r["text"] or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", text)
        windows = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
        inside = {k for i in range(len(w) - 4) if windows[tuple(w[i : i + 5])] > 1 for k in range(i, i + 5)}
        kept = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        assert (r["n_words"], r["word_chars"], r["n_repeat_words"], r["n_dup_lines"]) == (len(w), sum(map(len, w)), len(inside), len(kept) - len(set(kept)))
        assert r["n_symbols"] == len(re.findall(r"[#*$%&|<>]", text))


def test_rules_are_learned_and_clean_documents_stay(spark):
    rows = [(i, prose(i, 60) if i % 2 else " ".join(f"{w}###" for w in prose(i, 60).split()), i % 2) for i in range(120)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, quality int")
    rules = quality.learn_rules(frame.select("doc_id", "text"), frame.select("doc_id", "quality"))
    assert rules and all(r.precision >= 0.9 for r in rules)
    assert {(r["doc_id"] % 2 == 1, r["kept"]) for r in quality.judge(frame, rules).collect()} == {(True, True), (False, False)}
    assert quality.learn_rules(frame.select("doc_id", "text"), frame.select("doc_id", "quality").limit(0)) == []


# --- 9 language ID, 10 mixing -----------------------------------------------------------------------------------


def test_languages_held_out(spark, data):
    docs = spark.read.parquet(data.replace("sf0.001", "sf0.01") + "/documents.parquet").select("doc_id", "text", "lang")
    odd = spark.createDataFrame([(10**6, None, None), (10**6 + 1, "123 !!", None), (10**6 + 2, "", "en")], docs.schema)
    model = langid.fit(docs)
    found = langid.identify(docs.unionByName(odd), model, keep=("doc_id", "lang")).toPandas().set_index("doc_id")
    held = found[[__import__("zlib").crc32(str(i).encode()) % 5 == 0 for i in found.index]].dropna()
    assert (held.lang == held.lang_pred).mean() > 0.97
    assert set(found.loc[10**6 :].lang_pred) == {"und"} and found.score.between(0, 1).all()
    assert langid.fit(docs.limit(0)) is None


def test_a_kept_text_goes_to_python_once(docs, monkeypatch):
    sent, run = task_of(monkeypatch, lambda: langid.identify(docs, None, keep=("text", "lang")))
    assert sent.columns == ["text", "lang"]
    batches = run()
    assert batches[0].schema.names == ["text", "lang", "lang_pred", "score"] and sum(b.num_rows for b in batches) == docs.count()
    model = langid.fit(docs)
    key = lambda r: (r["doc_id"], r["lang_pred"], round(r["score"], 5))
    first = langid.identify(docs, model, keep=("text", "doc_id", "lang")).collect()
    assert sorted(map(key, first)) == sorted(map(key, langid.identify(docs, model).collect()))
    assert Counter((r["doc_id"], r["text"], r["lang"]) for r in first) == Counter(map(tuple, docs.select("doc_id", "text", "lang").collect()))


def test_training_rows_are_chosen_without_python_workers(spark):
    frame = spark.range(40).select(F.col("id").alias("doc_id"), F.lit("some text").alias("text"), F.concat(F.lit("l"), F.col("id") % 2).alias("lang"))
    sample, languages = langid.training_rows(frame, 5)
    assert languages == ["l0", "l1"] and sample.groupBy("lang").count().where("count = 5").count() == 2
    assert "ExistingRDD" not in sample._jdf.queryExecution().executedPlan().toString()


def test_languages_of_all_scripts_and_numbers_are_told_apart(spark):
    rng = random.Random(9)
    scripts = {"el": range(0x3B1, 0x3CA), "ru": range(0x430, 0x450), "hy": range(0x561, 0x587)}
    scripts |= {f"z{i:03}": range(0x4E00 + 25 * i, 0x4E00 + 25 * i + 25) for i in range(110)}

    def text(lang):
        return " ".join("".join(chr(rng.choice(scripts[lang])) for _ in range(5)) for _ in range(20))

    rows = [(lang, text(lang)) for lang in scripts for _ in range(8)] + [("z000", text("z000") * 9) for _ in range(40)]
    frame = spark.createDataFrame([(i, t, lang) for i, (lang, t) in enumerate(rows)], "doc_id long, text string, lang string")
    new = spark.createDataFrame([(i, text(lang), lang) for i, lang in enumerate(scripts)], frame.schema)
    found = langid.identify(new, langid.fit(frame, landmarks=3), keep=("lang",)).toPandas()
    assert (found.lang == found.lang_pred).all()


def test_mix_meets_targets_and_caps(docs):
    mixed = mixing.mix(docs).toPandas()
    assert len(mixed) == docs.count()
    by = mixed.groupby("source", dropna=False).agg(size=("size", "sum"), target=("target", "first"), taken=("taken", "sum"))
    assert (by.target <= 2 * by["size"] + 1e-9).all() and ((by.taken - by.target).abs() <= 1).all()
    assert (mixed.taken <= 2 * mixed["size"]).all()
    assert by.target.sum() == pytest.approx(min(1.5, 2) * mixed["size"].sum())
    again = mixing.mix(docs.repartition(5), buckets=64).toPandas()
    key = ["doc_id", "tie", "size", "taken"]
    assert sorted(map(tuple, mixed[key].values)) == sorted(map(tuple, again[key].values))


# --- empty tables, the pipeline ---------------------------------------------------------------------------------


def test_empty_tables(spark, nothing):
    ranks, pattern = bpe.vocabulary()
    vectors = spark.createDataFrame([], "vec_id long, embedding array<float>")
    frames = [
        bpe.encode(nothing, ranks, pattern), topk.top_k(vectors, F.col("vec_id") % 20 == 0), suffixes.drop_repeats(nothing),
        minhash.near_duplicates(nothing), lines.dedup_lines(nothing), licenses.scan_licenses(nothing), quality.judge(nothing, []),
        langid.identify(nothing, None), mixing.mix(nothing), html_text.extract(spark.createDataFrame([], "page_id long, url string, html string")),
    ]
    assert [f.count() for f in frames] == [0] * len(frames)


def test_pipeline_stages_keep_columns_and_clean_documents(spark, docs, nothing):
    import corpus_pipeline

    now, counts = docs, []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = spark.createDataFrame(stage(spark, now, "").collect(), docs.schema)
        assert now.columns == docs.columns, name
        counts.append(sorted(r["doc_id"] for r in now.collect()))
    assert counts[0] == sorted(i for i, t in pairs_of(docs) if re.search(r"[^\W\d_]", t))
    assert counts[1] == counts[0] and len(counts[2]) == len(set(counts[2]))
    assert corpus_pipeline.STAGES[-1][1](spark, now, "").count() == len(counts[3])
    kept = stages.keep_one_of_each_group(spark, docs, "")
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 4, 5, 6, 7, 8, 9, 10, 11, 12]
    for _, stage in corpus_pipeline.STAGES:
        nothing = stage(spark, nothing, "")
        assert nothing.count() == 0


CLASHES = ("lang_pred", "score", "n_dropped", "n_near_dropped", "n_links", "__id", "__text", "__copy", "__key", "node", "id", "taken", "c0")


def test_pipeline_survives_clashing_columns(spark, docs):
    """Extra columns of any name come through all stages as they were."""
    import corpus_pipeline

    now = docs
    for i, name in enumerate(CLASHES):
        now = now.withColumn(name, F.concat(F.lit(f"{i}-"), F.col("doc_id").cast("string")))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        schema = now.schema
        now = spark.createDataFrame(stage(spark, now, "").collect(), schema)
        assert now.schema == schema, name
        for r in now.collect():
            assert [r[c] for c in CLASHES] == [f"{i}-{r['doc_id']}" for i in range(len(CLASHES))]
    assert corpus_pipeline.STAGES[-1][1](spark, now, "").columns == ["doc_id", "source", "n_tokens", "ids", "decoded_sha256"]
    dropped = lines.dedup_lines(docs.withColumn("n_dropped", F.lit("mine")))
    assert dropped.columns == [*docs.columns, "n_dropped", "n_dropped_", "n_near_dropped", "n_links"]
    assert {r["n_dropped"] for r in dropped.collect()} == {"mine"}
    judged = langid.identify(docs.withColumn("score", F.lit("mine")), None, keep=("doc_id", "score"))
    assert judged.columns == ["doc_id", "score", "lang_pred", "score_"]


def test_rows_that_share_an_id_stay_unless_they_are_copies(spark):
    base, other, third = prose(21, 120), prose(22, 120), prose(23, 120)
    near = base.replace(base.split()[60], "changed", 1)
    rows = [(5, base), (5, other), (5, other), (7, near), (3, other + " tail"), (9, third), (9, third), (9, None), (9, ""), (None, base)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    kept = stages.keep_one_of_each_group(spark, frame, "")
    got = sorted(((r["doc_id"] or 0, r["text"] or "") for r in kept.collect()))
    # of the group of base and near the row of id 5 stays; other has its least id in row 3; null and empty texts are one form
    assert got == sorted([(5, base), (3, other + " tail"), (9, third), (9, ""), (0, base)])


def plain_pipeline(rows, edits, shortest):
    """Language ID (letters), line dedup, near-dedup of rows of one id each; texts as they reach the mix."""

    def distance(a, b):
        last = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row = [i]
            for j, y in enumerate(b, 1):
                row.append(min(row[-1] + 1, last[j] + 1, last[j - 1] + (x != y)))
            last = row
        return last[-1]

    rows = [(i, t, s) for i, t, s in rows if t and re.search(r"[^\W\d_]", t)]
    first = {}
    for i, t, _ in sorted(rows):
        for n, x in enumerate(t.split("\n")):
            if x.strip(" \t\n\v\f\r"):
                first.setdefault(x, (i, n))
    bad = set()
    for x, at in first.items():
        if len(x) >= shortest:
            if any(len(y) >= shortest and abs(len(x) - len(y)) <= edits and x != y and first[y] < at and distance(x, y) <= edits for y in first):
                bad.add(x)
    out = []
    for i, t, s in rows:
        kept = [x for n, x in enumerate(t.split("\n")) if not x.strip(" \t\n\v\f\r") or (x not in bad and first[x] == (i, n))]
        out.append((i, "\n".join(kept), s))
    sets = {}
    for i, t, _ in out:
        w = re.findall(r"[^\x20\x09-\x0D]+", t.lower())
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: t for i, t, _ in out if find(i) == i}


def test_pipeline_equals_plain_python(spark, tmp_path):
    """``run()`` over a fixture with exact and near copies, repeated lines and junk."""
    import corpus_pipeline

    ranks, pattern = bpe.vocabulary()
    code = bpe.Coder(bpe.ByteBPE(bpe.parse_ranks(ranks)), pattern)
    rows = []
    for i in range(24):
        text = "\n".join(prose(100 + 10 * i + k, 30) for k in range(4))
        rows.append((3 * i, text, f"s{i % 3}"))
        if i % 4 == 0:
            rows.append((3 * i + 1, text, "s0"))
        if i % 6 == 0:
            rows.append((3 * i + 2, " ".join(text.split()[:-2] + ["other"]), "s1"))
    rows += [(900, "a shared line of some words\n" + prose(990, 40), "s2"), (901, "a shared line of some words\n" + prose(991, 40), "s2")]
    rows += [(902, "12345 !!", "s0"), (903, None, "s0"), (904, "a shared line of some wards\n" + prose(992, 40), None)]
    frame = spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in rows], "doc_id long, text string, lang string, source string, n_chars long")
    frame.coalesce(2).write.parquet(str(tmp_path / "documents.parquet"))
    kept = plain_pipeline(rows, lines.EDITS, lines.SHORTEST)
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    wordless = {i for i, t in kept.items() if not t.split()}
    assert {r["doc_id"] for r in got} <= set(kept) - wordless
    for r in got:
        assert r["ids"] == code.rows([kept[r["doc_id"]]], ("ids",))[0][0]
    sizes = Counter()
    for i, t in kept.items():
        sizes[dict((a, c) for a, _, c in rows)[i]] += len(t.split())
    taken = Counter()
    for r in got:
        taken[r["source"]] += len(kept[r["doc_id"]].split())
    # weights 5, 2, 1, 5 share 150 percent of the words, twice a source's size at most; whole documents come near that
    wanted, open_, left = {}, dict(zip(["s0", "s1", "s2", None], [5, 2, 1, 5], strict=True)), 1.5 * sum(sizes.values())
    while open_:
        full = [s for s, w in open_.items() if left * w / sum(open_.values()) >= 2 * sizes[s]]
        for s in full or list(open_):
            wanted[s] = 2 * sizes[s] if full else left * open_[s] / sum(open_.values())
        if not full:
            break
        left -= sum(2 * sizes[s] for s in full)
        open_ = {s: w for s, w in open_.items() if s not in full}
    longest = max(len(t.split()) for t in kept.values())
    assert all(abs(taken[s] - wanted[s]) <= longest for s in wanted)


def test_sibling_licences_and_short_forms(spark):
    """One word tells licences apart; short forms count; the larger template wins in its block."""
    wanted = {
        "Licensed under CC BY 4.0.": "cc-by", "Licensed under CC BY-SA 4.0": "cc-by,cc-by-sa", "Licensed under CC BY-NC 4.0": "cc-by,cc-by-nc",
        "Licensed under CC BY-NC-SA\n4.0": "cc-by,cc-by-nc-sa", "This is under the GNU General Public License, version 2.": "gpl,gpl-2",
        "Under the GNU Lesser General Public License version 2.1": "gpl,lgpl-2.1", "GNU Affero General Public License, version 3": "agpl-3,gpl",
        "the GNU General Public License, version 3": "gpl,gpl-3", "Released under the MIT License.": "mit", "Use is under the BSD\n# License": "bsd",
        "licensed under a Creative Commons Attribution-NonCommercial 4.0 International License": "cc-by-nc",
        "licensed under a Creative Commons Attribution 4.0 International License": "cc-by",
        "Mozilla Public License, version 2.0": "mpl-2.0", "under a license of MITRE": "", "CC 4.0 licensed under": "",
    }
    frame = spark.createDataFrame(list(enumerate(wanted)), "doc_id long, text string")
    got = {r["text"]: ",".join(r["labels"]) for r in licenses.scan_licenses(frame).join(frame, "doc_id").collect()}
    assert got == wanted


def test_op7_sql_knows_wrapped_notices(spark, tmp_path):
    duckdb = pytest.importorskip("duckdb")
    texts = ["# Permission is hereby granted, free\n# of charge, to any person obtaining a copy of\n# this software and associated documentation files", None, ""]
    texts += ["Released under\nthe MIT\n\nLicense", "x\n" * 30 + "Licensed under CC BY-NC\n4.0 all rights reserved"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted(tuple(r) for r in licenses.op7_license_scan(spark, str(tmp_path)).collect())
    connection = duckdb.connect()
    connection.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert got == sorted(connection.execute(licenses.OP7_SQL).fetchall())
    assert [r[6] for r in got] == ["mit", "", "", "mit", "cc-by,cc-by-nc,reserved"]


def test_edits_grow_with_the_line(spark):
    """Length classes: the shorter line of a pair decides, and every pair within its edits is found."""
    rng = random.Random(31)
    classes = [(0, 1), (30, 2), (60, 3)]
    rows, n = [], 0
    for _ in range(60):
        base = prose(rng.randrange(10**6), rng.randint(3, 18))[: rng.randint(14, 90)].strip()
        rows.append((n, base))
        for _ in range(2):
            c = list(base)
            for _ in range(rng.randint(1, 4)):
                k = rng.randrange(len(c))
                c[k : k + rng.randint(0, 1)] = rng.choice(["", "q", "zz"[: rng.randint(1, 2)]])
            n += 1
            rows.append((n, "".join(c)))
        n += 1
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r["doc_id"]: r["text"] for r in lines.dedup_lines(frame, edits=classes).collect()}

    def distance(a, b):
        last = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row = [i]
            for j, y in enumerate(b, 1):
                row.append(min(row[-1] + 1, last[j] + 1, last[j - 1] + (x != y)))
            last = row
        return last[-1]

    allowed = lambda a, b: max(k for least, k in classes if min(len(a), len(b)) >= least)
    for i, text in rows:
        near = any(j < i and (t == text or (len(t) >= 12 and len(text) >= 12 and distance(t, text) <= allowed(t, text))) for j, t in rows)
        assert found[i] == ("" if near else text), (i, text)


def test_lines_with_replaced_words_are_near(spark, tmp_path):
    """Words replaced, inserted, deleted, split and joined: every pair within its edits or words is found, and no other."""
    rng = random.Random(47)
    rows, n = [], 0
    for _ in range(70):
        base = prose(rng.randrange(10**6), rng.randint(4, 16)).split()
        rows.append((n, " ".join(base)))
        for _ in range(3):
            c = list(base)
            for _ in range(rng.randint(1, 3)):
                k = rng.randrange(len(c))
                rng.choice((
                    lambda: c.__setitem__(k, "replacement"), lambda: c.insert(k, "another"), lambda: c.__delitem__(k), lambda: c.__setitem__(k, c[k][:1] + " " + c[k][1:]),
                    lambda: c.__setitem__(slice(k, k + 2), ["".join(c[k : k + 2])]), lambda: c.__setitem__(k, c[k] + "x"), lambda: c.__setitem__(k, c[k] + " \t"),
                ))()
            n += 1
            rows.append((n, " ".join(c)))
        n += 1
    rows.append((n, "word word word word word word"))
    rows.append((n + 1, "word word word word word"))

    def distance(a, b):
        last = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row = [i]
            for j, y in enumerate(b, 1):
                row.append(min(row[-1] + 1, last[j] + 1, last[j - 1] + (x != y)))
            last = row
        return last[-1]

    texts = {t: t.split() for _, t in rows}
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    for classes in ([(5, 1)], [(5, 1), (9, 2)], [(6, 2), (12, 3)]):
        allowed = lambda a, b: max([k for least, k in classes if min(len(a), len(b)) >= least], default=0)  # noqa: B023, E731
        by_words = lambda a, b: bool(k := allowed(a, b)) and abs(len(a) - len(b)) <= k and distance(a, b) <= k
        near = {a: {b for b in texts if a != b and min(len(a), len(b)) >= 12 and (by_words(texts[a], texts[b]) or (abs(len(a) - len(b)) <= 1 and distance(a, b) <= 1))} for a in texts}
        found = {r["doc_id"]: r for r in lines.dedup_lines(frame, words=classes).collect()}
        seen = set()
        for i, text in rows:
            gone = text in seen or bool(near[text] & seen)
            assert (found[i]["text"], found[i]["n_links"]) == (("", len(near[text])) if gone else (text, 0)), (classes, i, text)
            seen.add(text)
    # the query and the pipeline's stage use them: one replaced word of eight and more, two of 24 and more
    long = prose(77, 30).split()
    swapped = [*long[:4], "replacement", *long[5:20], "another", *long[21:]]
    spark.createDataFrame([(1, " ".join(long)), (2, " ".join(swapped)), (3, " ".join(long[:9])), (4, " ".join(swapped[:9]))], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    assert [r["n_near_dropped"] for r in lines.op5_line_dedup(spark, str(tmp_path)).orderBy("doc_id").collect()] == [0, 1, 0, 1]
    left = stages.remove_repeated_lines(spark, spark.read.parquet(str(tmp_path / "documents.parquet")), "")
    assert {r["doc_id"] for r in left.where("text = ''").collect()} == {2, 4}


def test_crowds_of_near_lines_are_not_paired(spark):
    """Copies of one line with a word or two changed: links of all, as by brute force, but rows only for pairs of different classes."""
    rng = random.Random(53)
    long, short = prose(78, 30).split(), prose(79, 12).split()
    rows = []
    for base, most in ((long, 3), (short, 2)):
        for i in range(90):
            c = list(base)
            for _ in range(1 if i % 3 else most):
                c[rng.randrange(len(c)) if base is long else 5] = f"new{rng.randrange(10**6)}"
            if i % 15 == 7:
                rng.choice((lambda: c.insert(9, "more"), lambda: c.__delitem__(3), lambda: c.insert(11, c.pop(8))))()  # noqa: B023
            rows.append(" ".join(c))
        rows += [" ".join(base)] * 3
    rng.shuffle(rows)
    rows = list(enumerate(rows))

    def distance(a, b):
        last = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row = [i]
            for j, y in enumerate(b, 1):
                row.append(min(row[-1] + 1, last[j] + 1, last[j - 1] + (x != y)))
            last = row
        return last[-1]

    texts = {t: t.split() for _, t in rows}
    allowed = lambda a, b: 2 if min(len(a), len(b)) >= 24 else 1
    close = lambda a, b: (d := distance(texts[a], texts[b])) <= allowed(texts[a], texts[b]) or (d <= 2 and abs(len(a) - len(b)) <= 1 and distance(a, b) <= 1)
    near = {a: {b for b in texts if a != b and close(a, b)} for a in texts}
    found = {r["doc_id"]: r for r in lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"), words=lines.WORDS).collect()}
    seen = set()
    for i, text in rows:
        gone = text in seen or bool(near[text] & seen)
        assert (found[i]["text"], found[i]["n_links"]) == (("", len(near[text])) if gone else (text, 0)), (i, text)
        seen.add(text)
    assert sum(map(len, near.values())) > 10_000
    # a crowd four times as large has no more than that many times the rows
    made = []
    for size in (100, 400):
        crowd = [(0, " ".join(long), 50), *((i, " ".join([*long[: i % 30], f"new{i}", *long[i % 30 + 1 :]]), 1) for i in range(1, size))]
        pairs, classes = lines.near_pairs(spark.createDataFrame(crowd, "number long, line string, n long"), lines.EDITS, lines.WORDS)
        made.append(pairs.count() + classes.count())
    assert made[1] <= 4 * made[0] + 4, made


def test_lines_around_a_crowd_are_not_paired(spark):
    """Two words changed, words put in, out and elsewhere: links as by brute force, without rows for the pairs of a crowd."""
    rng = random.Random(59)
    long = prose(80, 30).split()
    long[11:14] = ["again"] * 3

    def crowd(size):
        found = {" ".join(long)}
        while len(found) < size:
            c, kind = list(long), rng.randrange(8)
            i, j = rng.randrange(30), rng.choice((3, 4, 12, 20))
            if kind < 4:  # often at the same places, by few words and those of the line
                c[j], c[i] = rng.choice(("new", "newer", long[j - 1], long[i])), f"new{rng.randrange(40)}"
            elif kind == 4:
                c[i] = f"new{rng.randrange(10**6)}"
            elif kind == 5:
                c.insert(i, f"new{rng.randrange(10**6)}")
            elif kind == 6:
                c[10:15] = rng.sample(c[10:15], 5)
            else:
                c[3:6] = rng.choice((["new", long[3], long[5]], [long[4], long[3], long[5]], ["newer", "new", long[4]], [long[3], "new", "newer"]))
                c[20] = rng.choice((long[20], "new"))
                c[21] = rng.choice((long[21], long[20], f"new{rng.randrange(9)}"))
            found.add(" ".join(c))
        return sorted(found, key=lambda t: (t != " ".join(long), rng.random()))

    def distance(a, b):
        last = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row = [i]
            for j, y in enumerate(b, 1):
                row.append(min(row[-1] + 1, last[j] + 1, last[j - 1] + (x != y)))
            last = row
        return last[-1]

    for classes, size in (([(8, 1), (24, 2)], 200), ([(8, 1), (24, 3)], 120)):
        texts = crowd(size)
        rows = list(enumerate([texts[0], *rng.sample(texts, len(texts)), texts[0]]))
        split = {t: t.split() for t in texts}
        near = {a: {b for b in texts if a != b and distance(split[a], split[b]) <= classes[1][1]} for a in texts}
        found = {r["doc_id"]: r for r in lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"), words=classes).collect()}
        seen = set()
        for i, text in rows:
            gone = text in seen or bool(near[text] & seen)
            assert (found[i]["text"], found[i]["n_links"]) == (("", len(near[text])) if gone else (text, 0)), (classes, i, text)
            seen.add(text)
    made = []
    for size in (150, 600):
        texts = [(0, " ".join(long), 50)]
        for i in range(1, size):  # two words changed, one of them at the place where the next line has another; each third one more word
            c = list(long)
            c[i % 30], c[(i + 1) % 30] = f"new{i}", f"new{i % 30}" if i % 2 else c[(i + 1) % 30]
            texts.append((i, " ".join([*c[:9], f"more{i}", *long[9:]] if i % 3 == 0 else c), 1))
        texts += [(size + i, " ".join([*long[: i % 30], f"put{i}", *long[i % 30 :]]), 1) for i in range(size // 3)]
        pairs, members = lines.near_pairs(spark.createDataFrame(texts, "number long, line string, n long"), lines.EDITS, lines.WORDS)
        made.append((pairs.count(), members.count()))
    assert sum(made[1]) <= 5 * sum(made[0]), made


def test_lines_without_a_common_window_are_not_near(spark):
    """The lines that keys are made of hold all near ones, and none that has nothing in common with another."""
    rng = random.Random(61)
    classes = [(0, 1), (24, 2)]
    rows = []
    for n in (*range(4, 30), 47, 48, 49, 50, 65):
        for edits in (1, 2):
            for _ in range(4):
                base = [f"w{len(rows)}x{rng.randrange(99)}" for _ in range(n)]  # no other pair has these words
                c = list(base)
                for _ in range(edits):
                    i = rng.randrange(len(c))
                    c[i : i + rng.randint(0, 1)] = rng.choice(([], ["new"], ["other"]))
                if c != base and edits <= (2 if min(len(c), n) >= 24 else 1):
                    rows += [(len(rows), " ".join(base), 1), (len(rows) + 1, " ".join(c), 1)]
    alone = [(10_000 + i, " ".join(f"a{i}x{j}" for j in range(10 + i)), 1) for i in range(40)]
    kept = lines.candidates(spark.createDataFrame(rows + alone, "number long, line string, n long"), 0, classes)
    assert {r["number"] for r in kept.collect()} == {r[0] for r in rows}


def test_pages_without_names_or_sections():
    """Layouts that the training pages don't have word for word."""
    t = "The council decided on Monday that the old road will stay open for now."
    menu = '<nav><ul><li><a href="/">Home</a></li><li><a href="/n">News</a></li></ul></nav>'
    model = html_text.train()
    for page in (
        f"<body><div><div><p>{t}</p></div></div></body>", f"{menu}<p>{t}</p><footer>Small print 2020</footer>", f"{menu}<div><p>{t}</p></div>",
        f'<table><tr><td><a href="/">Home</a></td><td>{t}</td></tr></table>', f"{menu}<div><div class='message'><p>{t}</p></div></div>",
        f"<article><p>{t}</p></article><ol class='commentlist'><li><p>I do not agree with any of this, as I said before.</p></li></ol>",
        f'<div><span>{t}</span></div><div><a href="#">x</a> <a href="#">yy</a></div>', f"{menu}<section><p>{t}</p></section><aside><p>{t} Not here.</p></aside>",
        f"<p>{t}<svg><svg></svg>no</svg></p>", f"<p>{t}<button>no <button>none</button></button></p>",
    ):
        assert html_text.main_text(page, model) == t, page
    assert html_text.main_text(menu, model) == ""
    assert html_text.main_text("<article><p>a<svg>open to the end", model).startswith("a")
