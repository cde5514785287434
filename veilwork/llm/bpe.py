"""Byte-level BPE: encoding by given ranks with a segment tree, and decoding.

A text is cut by a pattern and every piece is encoded alone.  A piece that is a
vocabulary entry is one token.  Otherwise the leaves of a segment tree over its
byte positions hold the rank of the pair that starts there, packed with the
position, so that the root is the leftmost pair of the lowest rank.  A merge
changes three leaves (the pair itself, its swallowed right half and the live
neighbour to the left), each by a climb of logarithmic length.  The trees of
many pieces of like length are climbed together as numpy rows.

Spark deals the documents to tasks; a task keeps the pieces it has met in a
bounded table.  Texts are encoded whole, piece by piece, so that a long text
needs memory only for itself and its ids.  Null is treated as the empty text:
no tokens, the digest of nothing.  Rows are independent: repeated rows give
repeated results, and columns of other names are not read.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from veilwork.llm.shared import small_batches, table

NONE = np.int64(1) << 62  # "no pair": larger than any packed rank
KNOWN_PIECES = 500_000  # pieces a task keeps at once; more are encoded anew
STRETCH = 50_000  # pieces of a text that are handled at once
TOGETHER = 128  # documents whose new pieces are encoded together; their pieces are held at once
OUTPUTS = {
    "n_tokens": "long", "ids": "array<int>", "ids_sha256": "string", "decoded": "binary", "decoded_sha256": "string",
}


def parse_ranks(data: bytes) -> dict[bytes, int]:
    """Ranks from lines of base64 entry and decimal rank."""
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in data.splitlines() if line)}


class ByteBPE:
    """Encoder and decoder of one vocabulary."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.entries = {i: b for b, i in ranks.items()}
        self.own = {i: i for i in self.entries}  # one object for each id, however many pieces have it
        self.byte_ids = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        pairs: dict[int, int] = {}
        for entry, rank in ranks.items():
            for cut in range(1, len(entry)):
                left, right = ranks.get(entry[:cut]), ranks.get(entry[cut:])
                if left is not None and right is not None:
                    pairs[left << 32 | right] = rank
        self.pairs = pairs
        self.pair_keys = np.array(sorted(pairs), np.int64)
        self.pair_ranks = np.array([pairs[k] for k in self.pair_keys.tolist()], np.int64)

    def pair_rank(self, left: np.ndarray, right: np.ndarray, at: np.ndarray, bits: int) -> np.ndarray:
        """Rank of the merged pair packed with the place, ``NONE`` if the two don't merge."""
        if not len(self.pair_keys):
            return np.full(len(left), NONE)
        keys = left << 32 | right
        found = np.minimum(np.searchsorted(self.pair_keys, keys), len(self.pair_keys) - 1)
        return np.where((self.pair_keys[found] == keys) & (right >= 0), self.pair_ranks[found] << bits | at, NONE)

    def merge(self, pieces: list[bytes]) -> list[tuple[int, ...]]:
        """Token ids of pieces that are no entries, by segment trees of one width."""
        n = np.array([len(p) for p in pieces])
        bits = max(1, int(n.max() - 1).bit_length())
        width, count = 1 << bits, len(pieces)
        inside = np.arange(width) < n[:, None]
        ids = np.full((count, width + 1), -1, np.int64)  # the last column stands for the end
        ids[:, :-1][inside] = self.byte_ids[np.frombuffer(b"".join(pieces), np.uint8)]
        after = np.minimum(np.arange(width + 1)[None, :] + 1, width).repeat(count, 0)
        after[np.arange(count), n - 1] = width
        before = np.arange(width + 1)[None, :].repeat(count, 0) - 1
        tree = np.full((count, 2 * width), NONE)
        place = np.tile(np.arange(width), count)
        tree[:, width:] = self.pair_rank(ids[:, :-1].ravel(), ids[:, 1:].ravel(), place, bits).reshape(count, width)
        for level in range(bits - 1, -1, -1):
            low, high = 1 << level, 2 << level
            tree[:, low:high] = np.minimum(tree[:, 2 * low : 2 * high : 2], tree[:, 2 * low + 1 : 2 * high : 2])

        def put(rows, leaves, values):
            """Point update: set a leaf and climb to the root."""
            node = leaves + width
            tree[rows, node] = values
            for _ in range(bits):
                node >>= 1
                tree[rows, node] = np.minimum(tree[rows, 2 * node], tree[rows, 2 * node + 1])

        live = np.flatnonzero(tree[:, 1] < NONE)
        while len(live):
            best = tree[live, 1]
            at = best & (width - 1)
            gone = after[live, at]
            right = after[live, gone]
            ids[live, at] = best >> bits  # the id of a merged pair is its rank
            ids[live, gone] = -1
            after[live, at] = right
            before[live, right] = at
            put(live, gone, NONE)
            put(live, at.copy(), self.pair_rank(ids[live, at], ids[live, right], at, bits))
            left = before[live, at]
            some = left >= 0
            rows, left = live[some], left[some]
            put(rows, left.copy(), self.pair_rank(ids[rows, left], ids[rows, at[some]], left, bits))
            live = live[tree[live, 1] < NONE]
        flat = ids[:, :-1]
        kept = flat >= 0
        out, start = list(map(self.own.__getitem__, flat[kept].tolist())), 0
        result = []
        for k in kept.sum(1).tolist():
            result.append(tuple(out[start : start + k]))
            start += k
        return result

    def merge_one(self, piece: bytes) -> tuple[int, ...]:
        """The same tree for one piece in plain Python: quicker than numpy where few trees stand side by side."""
        n = len(piece)
        bits = max(1, (n - 1).bit_length())
        width, none, pairs = 1 << bits, int(NONE), self.pairs
        ids = self.byte_ids[np.frombuffer(piece, np.uint8)].tolist()
        after, before = list(range(1, n + 1)), list(range(-1, n))
        tree = [none] * (2 * width)

        def leaf(i: int) -> int:
            rank = pairs.get(ids[i] << 32 | ids[after[i]]) if after[i] < n else None
            return none if rank is None else rank << bits | i

        for i in range(n):
            tree[width + i] = leaf(i)
        for node in range(width - 1, 0, -1):
            tree[node] = min(tree[2 * node], tree[2 * node + 1])
        while tree[1] < none:
            at = tree[1] & (width - 1)
            gone = after[at]
            ids[at] = tree[1] >> bits
            ids[gone] = -1
            after[at] = after[gone]
            before[after[gone]] = at
            for place, value in ((gone, none), (at, leaf(at)), (before[at], leaf(before[at]) if before[at] >= 0 else none)):
                if place >= 0:
                    node = place + width
                    tree[node] = value
                    while node > 1:
                        node >>= 1
                        low = min(tree[2 * node], tree[2 * node + 1])
                        if tree[node] == low:
                            break  # nothing changes further up
                        tree[node] = low
        return tuple(self.own[i] for i in ids if i >= 0)

    def encode_pieces(self, pieces: list[bytes], room: int = 1 << 17) -> dict[bytes, tuple[int, ...]]:
        """Ids of distinct pieces; trees of like width are built together, at most ``room`` leaves at once."""
        out, by_bits = {}, {}
        for p in pieces:
            if p in self.ranks:
                out[p] = (self.ranks[p],)
            else:
                by_bits.setdefault((len(p) - 1).bit_length(), []).append(p)
        for bits, group in by_bits.items():
            if len(group) < 32 or bits > 8:
                out.update((p, self.merge_one(p)) for p in group)
                continue
            step = max(1, room >> bits)
            for i in range(0, len(group), step):
                part = group[i : i + step]
                out.update(zip(part, self.merge(part), strict=True))
        return out


class Coder:
    """Encodes and decodes texts with a bounded memory of the pieces met so far."""

    def __init__(self, bpe: ByteBPE, pattern: str):
        self.bpe, self.pattern, self.known = bpe, regex.compile(pattern), {}
        self.strings = {i: str(i) for i in bpe.entries}

    def learn(self, pieces: set[str]) -> None:
        new = [p for p in pieces if p not in self.known]
        if not new:
            return
        raw = {p: p.encode() for p in new}
        found = self.bpe.encode_pieces(list(set(raw.values())))
        self.known.update((p, found[b]) for p, b in raw.items())

    def stretches(self, text: str) -> Iterator[list[str]]:
        if len(text) <= STRETCH:
            yield self.pattern.findall(text)
        else:
            matches = (m.group() for m in self.pattern.finditer(text))
            while part := list(islice(matches, STRETCH)):
                yield part

    def digest(self, stretches, outputs: tuple[str, ...]) -> tuple:
        """The wanted outputs of one text, given as lists of pieces; decoding starts from the ids alone."""
        ids_digest, decoded_digest, n = hashlib.sha256(), hashlib.sha256(), 0
        ids, decoded = [], []
        for pieces in stretches:
            try:
                part = list(chain.from_iterable(map(self.known.__getitem__, pieces)))
            except KeyError:
                if len(self.known) > KNOWN_PIECES:
                    self.known.clear()
                self.learn(set(pieces))
                part = list(chain.from_iterable(map(self.known.__getitem__, pieces)))
            if "ids_sha256" in outputs and part:
                ids_digest.update(((" " if n else "") + " ".join(map(self.strings.__getitem__, part))).encode())
            if "decoded_sha256" in outputs or "decoded" in outputs:
                back = b"".join(map(self.bpe.entries.__getitem__, part))
                decoded_digest.update(back)
                if "decoded" in outputs:
                    decoded.append(back)
            if "ids" in outputs:
                ids += part
            n += len(part)
        made = {
            "n_tokens": n, "ids": ids, "ids_sha256": ids_digest.hexdigest(), "decoded": b"".join(decoded),
            "decoded_sha256": decoded_digest.hexdigest(),
        }
        return tuple(made[k] for k in outputs)

    def rows(self, texts: list[str | None], outputs: tuple[str, ...]) -> list[tuple]:
        """Outputs of some texts; pieces that the shorter ones bring anew are encoded together."""
        short = [self.pattern.findall(t) if t and len(t) <= STRETCH else [] for t in texts]
        if len(self.known) > KNOWN_PIECES:
            self.known.clear()
        self.learn(set(chain.from_iterable(short)))
        return [
            self.digest(self.stretches(t) if t and len(t) > STRETCH else [pieces], outputs)
            for t, pieces in zip(texts, short, strict=True)
        ]


_CODERS: dict = {}


def _coder(data: bytes, pattern: str) -> Coder:
    """One coder per Python worker, vocabulary and pattern."""
    key = (hashlib.sha256(data).digest(), pattern)
    if key not in _CODERS:
        _CODERS.clear()
        _CODERS[key] = Coder(ByteBPE(parse_ranks(data)), pattern)
    return _CODERS[key]


def encode(docs: DataFrame, ranks: bytes, pattern: str, keep: tuple[str, ...] = ("doc_id",), outputs: tuple[str, ...] = tuple(OUTPUTS), text: str = "text") -> DataFrame:
    """The ``keep`` columns and the wanted outputs of every text.

    ``ranks`` is the content of the vocabulary file, read by the caller and
    broadcast (its size does not depend on the documents).
    """
    spark = docs.sparkSession
    shared = small_batches(spark).sparkContext.broadcast(ranks)
    kept = docs.select(*keep).schema
    from pyspark.sql.types import StructType, _parse_datatype_string

    added = _parse_datatype_string(", ".join(f"{k} {OUTPUTS[k]}" for k in outputs))
    schema = StructType([*kept.fields, *added.fields])
    types = {"n_tokens": pa.int64(), "ids": pa.list_(pa.int32()), "decoded": pa.binary()}

    def run(batches):
        coder = _coder(shared.value, pattern)
        for batch in batches:
            texts = batch.column(batch.num_columns - 1)
            for start in range(0, batch.num_rows, TOGETHER):
                made = coder.rows(texts.slice(start, TOGETHER).to_pylist(), outputs)
                columns = [batch.column(i).slice(start, TOGETHER) for i in range(len(kept))]
                columns += [pa.array(v, types.get(k, pa.string())) for k, v in zip(outputs, zip(*made, strict=True), strict=True)]
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)
        coder.known.clear()  # Spark uses the worker again, perhaps for something else

    return docs.select(*keep, docs[text].alias("__text")).mapInArrow(run, schema)


def decode(encoded: DataFrame, ranks: bytes, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The ``keep`` columns and ``decoded`` (binary) from a column ``ids``; null ids give null."""
    shared = encoded.sparkSession.sparkContext.broadcast(ranks)
    kept = encoded.select(*keep).schema
    from pyspark.sql.types import BinaryType, StructField, StructType

    schema = StructType([*kept.fields, StructField("decoded", BinaryType())])

    def run(batches):
        entries = _coder(shared.value, "").bpe.entries
        for batch in batches:
            ids = batch.column(batch.num_columns - 1).to_pylist()
            back = [None if x is None else b"".join(map(entries.__getitem__, x)) for x in ids]
            columns = [batch.column(i) for i in range(len(kept))]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(back, pa.binary())], names=schema.names)

    return encoded.select(*keep, encoded["ids"].alias("__ids")).mapInArrow(run, schema)


def vocabulary(name: str = "byte_bpe_50k.tiktoken") -> tuple[bytes, str]:
    """Content of a public vocabulary file and the pattern that goes with it (read on the driver)."""
    import public_tokenizers

    with open(public_tokenizers.path(name), "rb") as f:
        return f.read(), public_tokenizers.PATTERN


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and decoded bytes of every document."""
    ranks, pattern = vocabulary()
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return encode(docs, ranks, pattern, outputs=("n_tokens", "ids_sha256", "decoded_sha256"))
