"""Cross-tokenizer alignment: minimal groups of tokens of two tokenizers that cover the same bytes, and counted links.

Tokenizer A (byte-level BPE) reads a blank and the text, tokenizer B (pieces with byte
fallback) the text, before which it sets that blank itself; both as plain text. A token of A
and one of B are joined where their byte ranges overlap; the components of this bipartite
graph, by union-find over all texts of a chunk at once, are the minimal groups: what lies
between two offsets where tokens of both end. The members of a component expand to its links:
its A-B occurrence pairs whose byte ranges end together, or, with links="overlap", all that
share a byte.

How many links of the whole corpus hold an id pair linked is counted in two levels: each task
counts its own, and a shuffle of (pair, count) sums them. A link counts as best where its pair
is counted most among those of its B id. Counts return to the documents without a shuffle
of links: the TOP most frequent pairs are sent to every task, and a document's other pairs,
none of which can hold more than 1 / TOP of all links, are joined.

Cases: a null or empty text, and one whose A or B tokens' bytes are not the blank and the text (characters
that B writes otherwise), have no tokens: zeros, and the empty string for the groups; ties for
a B id's highest count are all best; repeated rows are texts of their own, counted as often as
they come; texts of any length are read whole; an empty table gives an empty table; null ids
are kept. Further columns are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import public_tokenizers
import sentencepiece
from pyspark.sql import DataFrame, functions as F

from codeloom.llm import packing
from codeloom.llm._spark import Scratch, arrow_rows

A_FILE, B_FILE = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Pairs whose counts every task holds (16 bytes each).
TOP = 1 << 20
#: Characters worked on at once, unless a single text is longer; pairs a task counts before it sends them on.
CHUNK_CHARS, HELD_PAIRS = 1 << 18, 1 << 19
TEXT_ROWS = 512
_SHIFT = 32


class Side:
    """Ids of texts by one tokenizer, and the bytes that an id stands for."""

    def __init__(self, of_id: list[bytes], encode):
        self.bytes, self.encode = of_id, encode
        self.size = np.array([len(b) for b in of_id], np.int64)
        #: An id's decimal digits followed by a comma, a bar and a semicolon, in turn.
        self.digits = np.array([f"{i}{end}" for i in range(len(of_id)) for end in ",|;"], object)


@cache
def side_a(path: str) -> Side:
    with open(path, encoding="utf-8") as f:
        vocab = json.load(f)["model"]["vocab"]
    of, coder = packing._byte_of(), packing.encoder(path)
    names = {i: bytes(of[c] for c in t) if all(c in of for c in t) else t.encode() for t, i in vocab.items()}
    return Side([names.get(i, b"") for i in range(max(names) + 1)], lambda texts: coder.encode([" " + t for t in texts]))


@cache
def side_b(path: str) -> Side:
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = [model.id_to_piece(i) for i in range(model.get_piece_size())]
    names = [bytes([int(p[3:5], 16)]) if model.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
    return Side(names, lambda texts: [np.array(ids, np.uint32) for ids in model.encode(texts, num_threads=1)])


def components(n: int, one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """The smallest member of each node's component, of a graph of nodes 0 to n - 1 with edges one[i] - two[i]: union-find, all edges at once.

    A round hangs each edge's larger root below the smaller one and then lets every node
    point to its root; edges within a tree drop out.
    """
    root = np.arange(n)
    while len(one):
        low, high = np.minimum(root[one], root[two]), np.maximum(root[one], root[two])
        np.minimum.at(root, high, low)
        while True:
            up = root[root]
            if np.array_equal(up, root):
                break
            root = up
        open_ = root[one] != root[two]
        one, two = one[open_], two[open_]
    return root


def overlaps(end_a: np.ndarray, end_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pairs (i, j) of tokens, without empty ones, that share a byte; both sides cover the same bytes."""
    # The token of the other side that holds a token's last byte, from both sides.
    of_a, of_b = np.searchsorted(end_b, end_a), np.searchsorted(end_a, end_b)
    mine = end_b[of_a] != end_a
    return np.concatenate([np.flatnonzero(mine), of_b]), np.concatenate([of_a[mine], np.arange(len(end_b))])


class Aligned:
    """The alignment of the texts of a chunk, whose tokens of each side stand one behind another.

    first_a, first_b: index of each text's first token (one more at the end); group_a,
    group_b: group of each token, ascending; first_group likewise.
    """

    def __init__(self, ids_a: list[np.ndarray], ids_b: list[np.ndarray], a: Side, b: Side):
        join = lambda xs: np.concatenate([*xs, np.zeros(0, np.uint32)]).astype(np.int64)
        self.a, self.b = join(ids_a), join(ids_b)
        self.first_a, self.first_b = (np.append(0, np.cumsum([len(x) for x in xs])).astype(np.int64) for xs in (ids_a, ids_b))
        # Both sides of a text cover the same bytes, so offsets run through the whole chunk.
        self.end_a, self.end_b = np.cumsum(a.size[self.a]), np.cumsum(b.size[self.b])
        self.i, self.j = overlaps(self.end_a, self.end_b)
        n = len(self.a)
        root = components(n + len(self.b), self.i, n + self.j)
        # A component's smallest member is its first token of A.
        starts, self.group_a = np.unique(root[:n], return_inverse=True)
        self.group_b = np.searchsorted(starts, root[n:])
        self.first_group = np.searchsorted(starts, self.first_a)

    def links(self, kind: str) -> tuple[np.ndarray, np.ndarray]:
        """Tokens (i, j) of the links, by ascending group."""
        if kind == "overlap":
            order = np.lexsort((self.j, self.i))
            return self.i[order], self.j[order]
        # Of a component's members only the last of each side can end where the other side's do.
        i, j = (np.flatnonzero(np.append(g[1:] != g[:-1], True)) if len(g) else np.zeros(0, np.int64) for g in (self.group_a, self.group_b))
        return i, j

    def written(self, a: Side, b: Side) -> Iterator[str]:
        """Each text's groups as a1,a2|b1;a3|b2,b3."""
        last_a = np.append(self.group_a[1:] != self.group_a[:-1], True)[: len(self.a)]
        last_b = np.append(self.group_b[1:] != self.group_b[:-1], True)[: len(self.b)]
        shown = np.concatenate([a.digits[self.a * 3 + last_a], b.digits[self.b * 3 + 2 * last_b]])
        # Within a group the tokens of A come first.
        order = np.argsort(np.concatenate([self.group_a * 2, self.group_b * 2 + 1]), kind="stable")
        shown, at = shown[order].tolist(), self.first_a + self.first_b
        for x, y in zip(at[:-1].tolist(), at[1:].tolist()):
            yield "".join(shown[x:y])[:-1]


FIELDS = "n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"


def aligned(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", a_path: str | None = None, b_path: str | None = None, links: str = "end", written: bool = False) -> DataFrame:
    """(id, n_a, n_b, n_groups, n_links, groups_sha256, links): links are A's id << 32 | B's id, one an occurrence; with written, also groups, as text."""
    if links not in ("end", "overlap"):
        raise ValueError("links are 'end' or 'overlap'")
    kind = docs.schema[id_col].dataType.simpleString()
    names = ["id", *(f.split()[0] for f in FIELDS.split(", ")), "links", *(["groups"] if written else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = side_a(a_path or public_tokenizers.path(A_FILE)), side_b(b_path or public_tokenizers.path(B_FILE))

        def out(ids: pa.Array, texts: list[str]) -> pa.RecordBatch:
            ids_a, ids_b = ([t if u else t[:0] for t, u in zip(side.encode(texts), texts)] for side in (a, b))
            for n, text in enumerate(texts):
                whole = b" " + text.encode() if text else b""
                if not all(b"".join(map(side.bytes.__getitem__, ids[n].tolist())) == whole for side, ids in ((a, ids_a), (b, ids_b))):
                    ids_a[n], ids_b[n] = ids_a[n][:0], ids_b[n][:0]
            done = Aligned(ids_a, ids_b, a, b)
            i, j = done.links(links)
            until = np.searchsorted(i, done.first_a)
            keys = (done.a[i] << _SHIFT) | done.b[j]
            groups = list(done.written(a, b))
            columns = [
                ids, *(pa.array(np.diff(x).astype(np.int64)) for x in (done.first_a, done.first_b, done.first_group, until)),
                pa.array([hashlib.sha256(g.encode()).hexdigest() if g else "" for g in groups], pa.string()),
                pa.ListArray.from_arrays(pa.array(until, pa.int32()), pa.array(keys)), *([pa.array(groups, pa.string())] if written else []),
            ]
            return pa.RecordBatch.from_arrays(columns, names)

        for batch in batches:
            at, texts, chars = 0, [], 0
            for text in batch.column(1):
                texts.append(text.as_py() or "")
                chars += len(texts[-1])
                if chars >= CHUNK_CHARS:
                    yield out(batch.column(0).slice(at, len(texts)), texts)
                    at, texts, chars = at + len(texts), [], 0
            if texts:
                yield out(batch.column(0).slice(at, len(texts)), texts)

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, {FIELDS}, links array<long>" + (", groups string" if written else ""))


def pair_counts(rows: DataFrame) -> DataFrame:
    """(pair, a, b, count, best) of all links of rows(links): best where no pair of the same B id is counted more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def total() -> tuple[np.ndarray, np.ndarray]:
            pair, at = np.unique(np.concatenate([p for p, _ in held]), return_inverse=True)
            return pair, np.bincount(at, np.concatenate([c for _, c in held]), len(pair)).astype(np.int64)

        for batch in batches:
            got = np.unique(batch.column(0).flatten().to_numpy(zero_copy_only=False), return_counts=True)
            held.append(got)
            n += len(got[0])
            if n > 4 * HELD_PAIRS or (n > HELD_PAIRS and len(held) > 8):
                held = [total()]
                n = len(held[0][0])
                if n > HELD_PAIRS:
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in held[0]], ["pair", "count"])
                    held, n = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in total()], ["pair", "count"])

    counts = rows.select("links").mapInArrow(run, "pair long, count long").groupBy("pair").agg(F.sum("count").alias("count"))
    counts = counts.select("pair", F.shiftright("pair", _SHIFT).alias("a"), F.col("pair").bitwiseAND((1 << _SHIFT) - 1).alias("b"), "count")
    # A row for each id of B at most.
    most = counts.groupBy("b").agg(F.max("count").alias("most"))
    return counts.join(most, "b").select("pair", "a", "b", "count", (F.col("count") == F.col("most")).alias("best"))


def scored(rows: DataFrame, counts: DataFrame, s: Scratch) -> DataFrame:
    """rows of aligned(), tables both, with n_best and count_sum over their links, without the links."""
    top = counts.orderBy(F.desc("count"), "pair").limit(TOP).select("pair", "count", "best").orderBy("pair").toArrow()
    columns = [top.column(c).to_numpy() for c in ("pair", "count", "best")]
    sent = rows.sparkSession.sparkContext.broadcast(columns)
    plain = [f for f in rows.schema.fields if f.name != "links"]
    names = [f.name for f in plain]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, count, best = sent.value
        for batch in batches:
            at = batch.schema.get_field_index("links")
            lists = batch.column(at)
            size = lists.value_lengths().to_numpy(zero_copy_only=False)
            key, row = lists.flatten().to_numpy(zero_copy_only=False), np.repeat(np.arange(len(batch)), size)
            place = np.minimum(np.searchsorted(pair, key), max(len(pair) - 1, 0))
            known = pair[place] == key if len(pair) else np.zeros(len(key), np.bool_)
            place, own = place[known], row[known]
            # Sums of counts can pass 2**53, so they are taken as integers.
            sums = np.zeros(len(batch), np.int64)
            np.add.at(sums, own, count[place])
            rest = np.searchsorted(row[~known], np.arange(len(batch) + 1))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(batch.schema.get_field_index(c)) for c in names), pa.array(np.bincount(own[best[place]], minlength=len(batch)).astype(np.int64)), pa.array(sums),
                 pa.ListArray.from_arrays(pa.array(rest, pa.int32()), pa.array(key[~known]))],
                [*names, "n_best", "count_sum", "rest"],
            )

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in plain)
    done = s.cut(rows.mapInArrow(run, f"{schema}, n_best long, count_sum long, rest array<long>"), "scored")
    links = done.select("row", F.explode("rest").alias("pair")).groupBy("row", "pair").agg(F.count(F.lit(1)).alias("n"))
    if not done.where(F.size("rest") > 0).limit(1).count():
        return s.keep(done).drop("rest")
    others = links.join(counts.select("pair", "count", "best"), "pair").groupBy("row").agg(
        F.sum(F.when(F.col("best"), F.col("n")).otherwise(0)).alias("_best"), F.sum(F.col("n") * F.col("count")).alias("_sum")
    )
    joined = done.drop("rest").join(others, "row", "left")
    return s.keep(s.cut(joined.select(*names, *((F.col(c) + F.coalesce(o, F.lit(0))).alias(c) for c, o in (("n_best", "_best"), ("count_sum", "_sum")))), "scored"))


def align(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", links: str = "end", written: bool = False, **paths) -> DataFrame:
    """One row a document: its id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256, and with written the groups."""
    # All jobs run inside, so that each of them passes few texts and lists of links to Python at once.
    with Scratch() as s, arrow_rows(docs.sparkSession, TEXT_ROWS):
        rows = s.cut(aligned(docs, id_col, text_col, links=links, written=written, **paths).withColumn("row", F.monotonically_increasing_id()), "aligned")
        counts = s.cut(pair_counts(rows), "pairs")
        done = scored(rows, counts, s)
    return done.select(F.col("id").alias(id_col), "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", *(["groups"] if written else []))
