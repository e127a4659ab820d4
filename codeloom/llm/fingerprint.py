"""Document fingerprints by a randomised edit embedding.

A walk reads a text: at step j it stands at character i, emits that character, and
moves on to i + 1 or stays, as a random bit shared by all texts says for (j, the
character). Two texts that differ by few edits soon walk in step again, so their
edit distance becomes a Hamming distance between the emitted strings. A
fingerprint samples SLOTS positions of each of WALKS emitted strings. A slot's
position for a walk of T steps is the last of a fixed record sequence below T (next
record = position / uniform number): uniform over the walk, and the same for two
walks of T and T' steps with probability min(T, T') / max(T, T'). A symbol is a
byte that hashes position and character, written as two hexadecimal digits.

Cases: a null text is the empty text, whose fingerprint is all ``00``; equal texts
have equal fingerprints; texts of any length are walked to their end; documents
of equal ids follow each other in no particular order; an empty table gives an
empty table; a null id comes first. Further columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from codeloom.llm._spark import components, cut, parts, ranges, salted_join

WALKS, SLOTS = 2, 64
#: Bands of the near-duplicate search: symbols a band, and least likeness of a link.
BAND_ROWS, SIMILARITY = 8, 0.8
#: Characters of the texts walked together, unless one is longer.
CHUNK_CHARS = 1 << 21
_STEPS, _PERIOD, _FEW = 64, 1 << 12, 12

_rng = np.random.default_rng(97)
#: Bit for (step modulo the period, character class); class 0 is the end and never moves.
_MOVES = _rng.integers(0, 2, (WALKS, _PERIOD, 256), dtype=np.uint8)
_MOVES[:, :, 0] = 0
_MOVE_INTS = np.ascontiguousarray(_MOVES.transpose(1, 0, 2)).ravel().astype(np.intp)


def _records(seed: int) -> np.ndarray:
    """Record positions of each slot, ascending, padded with a huge one."""
    rng, rows = np.random.default_rng(seed), []
    for _ in range(SLOTS):
        at, row = 0, [0]
        while at < 1 << 40:
            at = int((at + 1) / max(rng.random(), 1e-6))
            row.append(at)
        rows.append(row)
    width = max(map(len, rows))
    return np.array([r + [1 << 62] * (width - len(r)) for r in rows], np.int64)


_RECORDS = [_records(w + 1) for w in range(WALKS)]


def _classes(joined: np.ndarray) -> np.ndarray:
    """Characters as classes 1 to 255."""
    mixed = (joined * np.uint32(0x9E3779B1)) >> np.uint32(16)
    return (mixed % np.uint32(255)).astype(np.uint8) + np.uint8(1)


def _walk(text: np.ndarray, start: np.ndarray) -> tuple[list, np.ndarray]:
    """Emitted classes in blocks (first step, lanes, steps x lanes), and the steps of each lane.

    Each walk's lanes read their own copy of the text, whose classes lie 256 above
    those of the copy before; the end of a text has the class 0.
    """
    lanes, at = np.arange(len(start)), start.astype(np.intp)
    total, blocks, done, width = np.zeros(len(start), np.int64), [], 0, 256 * WALKS
    alive = text[at] & 255 != 0
    lanes, at = lanes[alive], at[alive]
    while len(lanes) > _FEW:
        block = np.empty((_STEPS, len(lanes)), text.dtype)
        for s in range(_STEPS):
            now = block[s]
            text.take(at, out=now, mode="clip")
            row = ((done + s) % _PERIOD) * width
            at += _MOVE_INTS[row : row + width].take(now, mode="clip")
        block &= 255
        total[lanes] += np.count_nonzero(block, axis=0)
        blocks.append((done, lanes, block))
        done += _STEPS
        alive = text[at] & 255 != 0
        if not alive.all():
            lanes, at = lanes[alive], at[alive]
    flat, mask = _MOVE_INTS.astype(np.uint8).tobytes(), _PERIOD - 1
    for lane, i in zip(lanes.tolist(), at.tolist()):
        base = int(text[i]) & ~255
        own, stop = bytearray(), i
        while True:
            part = (text[stop : stop + (1 << 16)] & 255).astype(np.uint8)
            end = np.flatnonzero(part == 0)
            own += part[: end[0]].tobytes() if len(end) else part.tobytes()
            if len(end):
                break
            stop += 1 << 16
        out, step, k, stop = bytearray(), done, 0, len(own)
        while k < stop:
            c = own[k]
            out.append(c)
            if flat[(step & mask) * width + base + c]:
                k += 1
            step += 1
        total[lane] = step
        blocks.append((done, np.array([lane]), np.frombuffer(bytes(out), np.uint8)[:, None]))
    return blocks, total


def fingerprints(texts: list[str]) -> np.ndarray:
    """A row of WALKS * SLOTS symbols (bytes) for each text."""
    n, sizes = len(texts), np.array([len(t) for t in texts], np.int64)
    one = _classes(np.frombuffer("\0".join([*texts, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)).astype(np.uint16)
    ends = np.cumsum(sizes + 1)
    one[ends - 1] = 0
    text = np.concatenate([one + np.uint16(256 * w) for w in range(WALKS)])
    order = np.argsort(-sizes, kind="stable")
    start = (ends - sizes - 1)[order]
    blocks, total = _walk(text, np.concatenate([start + w * len(one) for w in range(WALKS)]))
    total = total.reshape(WALKS, n)
    where = np.zeros((WALKS, n, SLOTS), np.int64)
    for walk in range(WALKS):
        for slot, records in enumerate(_RECORDS[walk]):
            where[walk, :, slot] = records[np.searchsorted(records, np.maximum(total[walk], 1), "left") - 1]
    where = where.reshape(WALKS * n, SLOTS)
    emitted = np.zeros((WALKS * n, SLOTS), np.uint8)
    for first, lanes, block in blocks:
        near = where[lanes] - first
        row, slot = np.nonzero((near >= 0) & (near < len(block)))
        emitted[lanes[row], slot] = block[near[row, slot], row]
    symbol = (where.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + emitted.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(40)
    symbol = (symbol % np.uint64(255)).astype(np.uint8) + np.uint8(1)
    symbol[total.ravel() == 0] = 0
    out = np.zeros((n, WALKS * SLOTS), np.uint8)
    out[order] = symbol.reshape(WALKS, n, SLOTS).transpose(1, 0, 2).reshape(n, -1)
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Share of equal symbols."""
    return (a == b).mean(axis=-1)


def _many(texts: list[str]) -> np.ndarray:
    """fingerprints() of any number of texts, in chunks of like length."""
    out = np.zeros((len(texts), WALKS * SLOTS), np.uint8)
    order = sorted(range(len(texts)), key=lambda i: len(texts[i]))
    at = 0
    while at < len(order):
        end, chars = at, 0
        while end < len(order) and (end == at or chars + len(texts[order[end]]) <= CHUNK_CHARS):
            chars += len(texts[order[end]]) + 1
            end += 1
        own = order[at:end]
        out[own] = fingerprints([texts[i] for i in own])
        at = end
    return out


def _hex(rows: np.ndarray) -> list[str]:
    return [r.tobytes().hex() for r in rows]


def fingerprint(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: its id and fingerprint."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(_hex(_many(texts)), pa.string())], ["id", "fingerprint"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, fingerprint string").withColumnRenamed("id", id_col)


def bucket_of(col: str, points: list[int]):
    """How many of the ascending points are not above an integer column, by binary search."""
    if not points:
        return F.lit(0)
    array = f"from_json('{points}', 'array<bigint>')"
    middle = "(s.lo + s.hi) div 2"
    return F.expr(
        f"aggregate(sequence(1, {len(points).bit_length() + 1}), named_struct('lo', 0L, 'hi', {len(points)}L), (s, x) -> "
        f"if(s.lo >= s.hi, s, if({array}[cast({middle} as int)] <= {col}, named_struct('lo', {middle} + 1L, 'hi', s.hi), named_struct('lo', s.lo, 'hi', {middle})))).lo"
    )


def in_turn(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(bucket, id, text, extra): documents dealt to buckets of consecutive ids; each bucket also has the next one's first row (extra).

    The first row of all is the extra row of the last bucket. Only split points and
    each bucket's smallest id, at most some thousand numbers, pass through the driver.
    """
    spark, rows = docs.sparkSession, docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where(F.col(id_col).isNotNull())
    bucket = bucket_of("id", ranges(docs, id_col))
    rows = rows.withColumn("bucket", bucket.cast("int"))
    firsts = rows.groupBy("bucket").agg(F.min("id").alias("id")).orderBy("bucket").collect()
    if not firsts:
        return rows.select("bucket", "id", "text", F.lit(False).alias("extra")).limit(0)
    before = {r["id"]: firsts[i - 1]["bucket"] for i, r in enumerate(firsts)}
    ends = spark.createDataFrame([(i, b) for i, b in before.items()], "id long, to int")
    one_each = rows.join(F.broadcast(ends), "id").groupBy("to", "id").agg(F.min("text").alias("text")).select(F.col("to").alias("bucket"), "id", "text", F.lit(True).alias("extra"))
    return rows.select("bucket", "id", "text", F.lit(False).alias("extra")).union(one_each)


def edited_and_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text is the text whose last quarter of code points gives way to as
    many first ones of the next document, by ascending id, the last one's next
    being the first. Rows with a null id stand for themselves: they are left out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
        held: list[tuple] = []  # the row that waits for its next one, with its fingerprint
        extra = None
        bucket = None

        def out(rows: list[tuple], prints: np.ndarray, following: list[tuple[str, np.ndarray]]) -> pa.RecordBatch:
            edited, sums = [], []
            for (_, text), (after, _) in zip(rows, following):
                k = len(text) // 4
                edited.append(text[: len(text) - k] + after[:k])
                sums.append(hashlib.sha256(edited[-1].encode("utf-8", "surrogatepass")).hexdigest())
            changed = _many(edited)
            nexts = np.stack([f for _, f in following])
            return pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], id_type), pa.array([len(r[1]) for r in rows], pa.int64()), pa.array(sums), pa.array(_hex(prints)), pa.array(_hex(changed)), pa.array(likeness(prints, changed)), pa.array(likeness(prints, nexts))], names
            )

        def finish() -> pa.RecordBatch | None:
            if not held:
                return None
            doc, text, own = held[0]
            after = extra if extra is not None else text
            return out([(doc, text)], own[None], [(after, _many([after])[0])])

        id_type = None
        for batch in batches:
            id_type = batch.column(1).type
            rows = list(zip(*(c.to_pylist() for c in batch.columns)))
            at = 0
            while at < len(rows):
                if rows[at][0] != bucket:
                    if (last := finish()) is not None:
                        yield last
                    bucket, held, extra = rows[at][0], [], None
                end = at
                chars = 0
                while end < len(rows) and rows[end][0] == bucket and chars < 2 * CHUNK_CHARS:
                    chars += len(rows[end][2] or "")
                    end += 1
                part = rows[at:end]
                at = end
                for r in part:
                    if r[3]:
                        extra = r[2] or ""
                own = [(r[1], r[2] or "") for r in part if not r[3]]
                if not own:
                    continue
                prints = _many([t for _, t in own])
                now = [(held[0][0], held[0][1])] if held else []
                now += own
                all_prints = np.concatenate([held[0][2][None], prints]) if held else prints
                if len(now) > 1:
                    yield out(now[:-1], all_prints[:-1], [(now[i + 1][1], all_prints[i + 1]) for i in range(len(now) - 1)])
                held = [(now[-1][0], now[-1][1], all_prints[-1])]
        if (last := finish()) is not None:
            yield last

    kind = docs.schema[id_col].dataType.simpleString()
    turned = in_turn(docs, id_col, text_col)
    # The extra row first, so that it is known when the bucket's last row comes.
    dealt = turned.repartition(parts(docs), "bucket").sortWithinPartitions("bucket", F.desc("extra"), "id")
    schema = f"id {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return dealt.select("bucket", "id", "text", "extra").mapInArrow(run, schema).withColumnRenamed("id", id_col)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY, band_rows: int = BAND_ROWS) -> DataFrame:
    """One row a document: id, class_id (the class's smallest id).

    Documents with equal fingerprints form one representative. Representatives
    that share a band of band_rows symbols are linked if the likeness of their whole
    fingerprints is at least ``similarity``; classes are the components of these
    links. In each band's bucket all members are compared with the smallest one;
    buckets that then hold several classes compare further members, four times as
    many each round, with those of other classes, until none is left uncompared that
    the triangle inequality on the distances from the smallest one does not rule out.
    """
    printed = cut(fingerprint(docs, id_col, text_col).select(F.col(id_col).alias("id"), "fingerprint"), "prints")
    reps = cut(printed.groupBy("fingerprint").agg(F.min("id").alias("rep")), "reps")
    width = 2 * band_rows
    bands = F.transform(F.sequence(F.lit(0), F.lit(WALKS * SLOTS // band_rows - 1)), lambda i: F.xxhash64(i, F.substring("fingerprint", i * width + 1, F.lit(width))))
    rows = cut(reps.select("rep", F.explode(bands).alias("band")), "bands")
    shared = rows.groupBy("band").agg(F.min("rep").alias("leader"), F.count(F.lit(1)).alias("n")).where("n > 1")
    members = cut(salted_join(rows, shared, ["band"], "rep"), "members")
    tested = cut(members.where("rep <> leader").select(F.col("leader").alias("a"), F.col("rep").alias("b")).distinct(), "pairs")
    scored = _scored(tested, reps)
    links = scored.where(F.col("near") >= similarity).select("a", "b")
    comps = components(links)
    to_leader = scored.select(F.col("a").alias("leader"), F.col("b").alias("rep"), "near")
    larger = members.where("n > 2").join(to_leader, ["leader", "rep"], "left").select("band", "rep", "n", F.coalesce("near", F.lit(1.0)).alias("near"))
    larger, turn = cut(larger, "larger"), 0
    while True:
        turn += 1
        now = larger.join(comps.withColumnRenamed("node", "rep"), "rep", "left").withColumn("comp", F.coalesce("comp", "rep"))
        mixed = now.groupBy("band").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("band")
        place = F.floor(F.pmod(F.xxhash64("rep", "band"), F.lit(1 << 30)) / (1 << 30) * F.col("n"))
        left = cut(now.join(mixed, "band", "left_semi").withColumn("place", place), "mixed")
        low, high = 4 ** (turn - 1) // 4, 4 ** (turn - 1)
        if not left.where(F.col("place") >= low).limit(1).count():
            break
        leads = left.where(F.col("place").between(low, high - 1)).select("band", F.col("rep").alias("x"), F.col("comp").alias("cx"), F.col("near").alias("nx"))
        # The share of unequal symbols is a metric: what lies farther apart seen from the bucket's leader cannot be alike.
        close = F.abs(F.col("near") - F.col("nx")) <= 1 - similarity + 1e-9
        met = leads.join(left.select("band", "rep", "comp", "near"), "band").where((F.col("comp") != F.col("cx")) & close).select(F.least("x", "rep").alias("a"), F.greatest("x", "rep").alias("b")).distinct()
        fresh = cut(met.join(tested, ["a", "b"], "left_anti"), "pairs")
        found = _scored(fresh, reps).where(F.col("near") >= similarity).select("a", "b")
        tested = tested.union(fresh)
        if found.limit(1).count():
            links = links.union(found)
            comps = components(links)
        larger = left.select("band", "rep", "n", "near")
    classes = reps.join(comps.withColumnRenamed("node", "rep"), "rep", "left").select("fingerprint", F.coalesce("comp", "rep").alias("class_id"))
    return salted_join(printed, classes, ["fingerprint"], "id").select(F.col("id").alias(id_col), "class_id")


def _scored(pairs: DataFrame, reps: DataFrame) -> DataFrame:
    """The pairs (a, b) of representatives with their fingerprints' likeness (near), as a table."""
    named = lambda c, name: reps.select(F.col("rep").alias(c), F.col("fingerprint").alias(name))
    both = pairs.join(named("b", "fingerprint"), "b").join(named("a", "other"), "a")
    symbols = F.sequence(F.lit(0), F.lit(WALKS * SLOTS - 1))
    same = F.aggregate(symbols, F.lit(0), lambda n, i: n + F.when(F.substring("fingerprint", 2 * i + 1, F.lit(2)) == F.substring("other", 2 * i + 1, F.lit(2)), 1).otherwise(0))
    return cut(both.select("a", "b", (same / (WALKS * SLOTS)).alias("near")), "scored")
