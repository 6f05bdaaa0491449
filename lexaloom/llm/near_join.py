"""N-gram Jaccard join by chosen paths (operator 10).

A text's set holds its word n-grams (words as in decontamination: A-Z lower-cased, runs of letters, digits and non-ASCII; a text
of fewer words is one n-gram). Two texts are linked if the Jaccard similarity of their sets of 64-bit n-gram hashes reaches
``threshold``. Candidates come from ``COORDINATES`` min-hash coordinates: the share of equal ones estimates the similarity, and
a pair is a candidate if it is at most three standard errors below ``threshold``.

Chosen paths: a node of the recursion samples ``BRANCH`` coordinates by a hash of its path, shared by all sets, and a set goes to
the child named by its value there. Similar sets stay together with a probability that the depth and the similarity
fix, so the number of runs follows from the target recall. The first ``DEPTH`` levels need no data but the set itself and
are walked at once. Nodes of at most ``small`` sets are compared in full. In a larger node all are compared with one pivot, and
those that it leaves unlinked with all the others, in blocks, however many they are: no member is lost. Only where ``deepest`` is
set beyond ``DEPTH`` are nodes with more than ``small`` unlinked sets split further, level by level, down to ``deepest``, where the
blocks finish them; the runs are then as many as that depth needs.

Texts with equal words are collapsed first, so a group of copies is one set, which carries the number of its different texts:
``n_links`` counts the other texts of the own set and the texts of each linked set, but copies of one text once. Candidates within nodes become star edges; connected
components are found by alternating large and small stars. Within each component all sets are then compared on their exact
n-grams, block against block, which gives the links, their number for each set, and by a second search the classes. N-grams are
kept for the sets with a candidate only. No list of all pairs of a group exists at any time.

Results for special cases: a null or wordless text has no n-grams, its own class and no links; texts with equal words are copies
of one set; a null id can be in a class, whose id is the smallest non-null one; repeated rows are copies; an empty table
gives an empty one; other columns are ignored (``representatives`` returns them unchanged).
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexaloom.llm import rolling as R
from lexaloom.llm.chunks import text_buffer
from lexaloom.llm.common import materialize, row_hash, ship, trimmed
from lexaloom.llm.decontaminate import _SEPARATES, _TO_WORDS

COORDINATES = 128
BRANCH, DEPTH = 2, 3
_FOLD = np.frombuffer(_TO_WORDS, np.uint8)
_A = R.mix(np.arange(1, COORDINATES + 1, dtype=np.uint64)) | np.uint64(1)
_S = R.mix(np.arange(1001, COORDINATES + 1001, dtype=np.uint64))
_SLICE = 256 << 10
_BITS = 1 << 24
#: n-grams of a set that a block allows for on average; classes of longer texts have blocks of fewer sets
_VOLUME = 1024


def recall_of_run(similarity: float, depth: int = DEPTH) -> float:
    """Probability that two sets of this similarity share a node at ``depth`` in one run."""
    p = 1.0
    for _ in range(depth):
        p = 1 - (1 - similarity * p) ** BRANCH
    return p


def runs_for(threshold: float, recall: float) -> int:
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - recall_of_run(threshold))))


def loosest(threshold: float) -> int:
    """Equal coordinates of a candidate: three standard errors below the threshold."""
    return max(1, math.floor(COORDINATES * threshold - 3 * math.sqrt(COORDINATES * threshold * (1 - threshold))))


def recall_of_runs(similarity: float, runs: int, least: int, depth: int = DEPTH) -> float:
    """Probability that two sets become a candidate, over the numbers of equal coordinates, which all runs share."""
    total = 0.0
    for k in range(least, COORDINATES + 1):
        total += math.comb(COORDINATES, k) * similarity**k * (1 - similarity) ** (COORDINATES - k) * (1 - (1 - recall_of_run(k / COORDINATES, depth)) ** runs)
    return total


def enough_runs(threshold: float, recall: float, least: int, depth: int = DEPTH) -> int:
    """The runs that reach ``recall`` at the threshold, or that come within 0.001 of what ``least`` leaves."""
    goal, runs = min(recall, recall_of_runs(threshold, 1 << 20, least, depth) - 0.001), runs_for(threshold, recall)
    while recall_of_runs(threshold, runs, least, depth) < goal:
        runs += 1
    return runs


def _hashed(data: np.ndarray, offsets: np.ndarray, ngram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each text: number of words, two hashes of the word sequence; the texts with words, their numbers of n-grams, the n-grams' hashes."""
    data = _FOLD[data]
    start, end, bounds = R.words_of_texts(data, offsets, _SEPARATES)
    count = np.diff(bounds)
    h = R.prefix(R.spans(R.byte_prefix(data), start, end))
    k1 = R.spans(h, bounds[:-1], bounds[1:])
    k2 = R.mix(k1 + R.spans(h, (bounds[:-1] + bounds[1:]) // 2, bounds[1:]) * np.uint64(3) + count.astype(np.uint64))
    some = np.flatnonzero(count > 0)
    sizes = np.minimum(count[some], ngram)
    grams = count[some] - sizes + 1
    at = R.ranges(bounds[:-1][some], grams)
    return count, k1, k2, some, grams, R.spans(h, at, at + np.repeat(sizes, grams))


def _signatures(data: np.ndarray, offsets: np.ndarray, ngram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each text: number of words, two hashes of the word sequence, 16-bit min-hashes."""
    count, k1, k2, some, grams, x = _hashed(data, offsets, ngram)
    out = np.zeros((len(count), COORDINATES), np.uint16)
    if len(some):
        first = np.cumsum(grams) - grams
        for i in range(COORDINATES):
            v = ((x ^ _S[i]) * _A[i] >> np.uint64(32)).astype(np.uint32)
            out[some, i] = np.minimum.reduceat(v, first).astype(np.uint16)
    return count, k1, k2, out


def signatures(docs: DataFrame, *, id_col: str, text_col: str, ngram: int) -> DataFrame:
    """Written table (uid, id, digest, n_words, k1, k2, sig), a row for each input row."""
    ship(docs.sparkSession)
    schema = T.StructType().add("id", docs.schema[id_col].dataType).add("digest", "string").add("n_words", "long").add("k1", "long").add("k2", "long").add("sig", "binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets, _ = text_buffer(batch.column(2))
            for at, upto in _slices(offsets):
                a, b = offsets[at], offsets[upto]
                count, k1, k2, sig = _signatures(data[a:b], offsets[at : upto + 1] - a, ngram)
                yield pa.record_batch({
                    "id": batch.column(0).slice(at, upto - at),
                    "digest": batch.column(1).slice(at, upto - at),
                    "n_words": pa.array(count, pa.int64()),
                    "k1": pa.array(k1.view(np.int64)),
                    "k2": pa.array(k2.view(np.int64)),
                    "sig": pa.array([row.tobytes() for row in sig], pa.binary()),
                })

    text = F.col(f"`{text_col}`")
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.md5(text.cast("binary")).alias("digest"), text.alias("text"))
    return materialize(rows.mapInArrow(trimmed(run), schema).select(F.monotonically_increasing_id().alias("uid"), "*"), "signatures")


def _slices(offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    at, n = 0, len(offsets) - 1
    while at < n:
        upto = min(n, max(at + 1, int(np.searchsorted(offsets, offsets[at] + _SLICE, side="right")) - 1))
        yield at, upto
        at = upto


def gram_sets(docs: DataFrame, wanted: DataFrame, *, text_col: str, ngram: int) -> DataFrame:
    """Written table (uid, size, grams) of wanted (uid, digest): the distinct 64-bit hashes of each set.

    The texts are read once more. A bitmap of fixed size keeps out nearly all that aren't wanted, so that no others are shuffled.
    """
    spark = docs.sparkSession
    ship(spark)
    bit = F.pmod(F.xxhash64("digest"), F.lit(_BITS))
    found = wanted.select(bit.alias("bit")).select(F.floor(F.col("bit") / 64).cast("long").alias("word"), F.expr("shiftleft(1L, cast(bit % 64 AS int))").alias("flag")).groupBy("word").agg(F.bit_or("flag").alias("flags")).toArrow()
    words = np.zeros(_BITS // 64, np.uint64)
    words[np.asarray(found.column("word"))] = np.asarray(found.column("flags")).view(np.uint64)
    held = spark.sparkContext.broadcast(words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flags, seen = held.value, set()
        for batch in batches:
            bits = np.asarray(batch.column(1)).astype(np.uint64)
            rows = []
            for i in np.flatnonzero(flags[bits >> np.uint64(6)] >> (bits & np.uint64(63)) & np.uint64(1)).tolist():
                if (digest := batch.column(0)[i].as_py()) not in seen:
                    seen.add(digest)
                    rows.append(i)
            some = batch.take(pa.array(rows, pa.int64()))
            data, offsets, _ = text_buffer(some.column(2))
            for at, upto in _slices(offsets):
                a, b = offsets[at], offsets[upto]
                _, _, _, texts, grams, x = _hashed(data[a:b], offsets[at : upto + 1] - a, ngram)
                ends = np.cumsum(grams)
                sets = {int(t): np.unique(x[e - n : e]).tobytes() for t, n, e in zip(texts, grams, ends)}
                yield pa.record_batch({"digest": some.column(0).slice(at, upto - at), "grams": pa.array([sets.get(i, b"") for i in range(upto - at)], pa.binary())})

    text = F.col(f"`{text_col}`")
    rows = docs.where(text.isNotNull()).select(F.md5(text.cast("binary")).alias("digest"), text.alias("text")).select("digest", bit.alias("bit"), "text")
    once = rows.mapInArrow(trimmed(run), "digest string, grams binary").groupBy("digest").agg(F.first("grams").alias("grams"))
    return materialize(once.join(wanted, "digest").select("uid", F.floor(F.octet_length("grams") / 8).cast("long").alias("size"), "grams"), "grams")


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    data, _, _ = text_buffer(column)
    return data.view(np.uint16).reshape(-1, COORDINATES)


def _step(path: np.ndarray, sig: np.ndarray) -> list[np.ndarray]:
    """The children of each row's node."""
    out, rows = [], np.arange(len(path))
    for c in range(BRANCH):
        coordinate = R.mix(path + np.uint64(2 * c + 1)) % np.uint64(COORDINATES)
        value = sig[rows, coordinate.astype(np.int64)].astype(np.uint64)
        out.append(R.mix(path ^ R.mix(coordinate << np.uint64(20) | value)))
    return out


def _walk(sets: DataFrame, runs: int) -> DataFrame:
    """(node, uid) of the first levels of every run."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sig = _matrix(batch.column(1))
            for r in range(runs):
                paths = [np.full(len(sig), R.mix(np.array([r + 77], np.uint64))[0])]
                for _ in range(DEPTH):
                    paths = [p for path in paths for p in _step(path, sig)]
                uid = pa.concat_arrays([batch.column(0)] * len(paths))
                yield pa.record_batch({"node": pa.array(np.concatenate(paths).view(np.int64)), "uid": uid})

    return sets.select("uid", "sig").mapInArrow(trimmed(run), "node long, uid long")


def _deeper(rows: DataFrame, sets: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            paths = _step(np.asarray(batch.column(0)).view(np.uint64), _matrix(batch.column(2)))
            yield pa.record_batch({"node": pa.array(np.concatenate(paths).view(np.int64)), "uid": pa.concat_arrays([batch.column(1)] * len(paths))})

    return rows.join(sets.select("uid", "sig"), "uid").select("node", "uid", "sig").mapInArrow(trimmed(run), "node long, uid long").distinct()


def by_group(df: DataFrame, keys: list[str], fn: Callable[[pa.Table], list[tuple]], schema: str) -> DataFrame:
    """fn over each group, groups being small: one sorted pass per partition, without a call of Spark per group."""
    names = [part.split()[0] for part in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None

        def groups(table: pa.Table, last: bool) -> tuple[list[tuple], pa.Table | None]:
            change = np.zeros(table.num_rows, bool)
            change[0] = True
            for k in keys:
                column = np.asarray(table.column(k))
                change[1:] |= column[1:] != column[:-1]
            first = np.append(np.flatnonzero(change), table.num_rows)
            upto = len(first) - 1 if last else len(first) - 2
            out: list[tuple] = []
            for a, b in zip(first[:upto], first[1:]):
                out += fn(table.slice(a, b - a))
            return out, None if last else table.slice(first[upto])

        def made(rows: list[tuple]) -> pa.RecordBatch:
            return pa.record_batch({n: pa.array([r[i] for r in rows], pa.int64()) for i, n in enumerate(names)})

        for batch in batches:
            table = pa.Table.from_batches([batch])
            held = pa.concat_tables([held, table]).combine_chunks() if held is not None else table
            if held.num_rows:
                rows, held = groups(held, False)
                if rows:
                    yield made(rows)
        if held is not None and held.num_rows:
            yield made(groups(held, True)[0])

    return df.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(trimmed(run), schema)


def _linked(a: np.ndarray, b: np.ndarray, least: int) -> np.ndarray:
    """Whether each row of a is linked to each row of b."""
    out = np.empty((len(a), len(b)), bool)
    step = max(1, (4 << 20) // (max(1, len(b)) * COORDINATES))
    for i in range(0, len(a), step):
        out[i : i + step] = (a[i : i + step, None, :] == b[None, :, :]).sum(2) >= least
    return out


def _star_edges(least: int) -> Callable[[pa.Table], list[tuple]]:
    def run(table: pa.Table) -> list[tuple]:
        uid = np.asarray(table.column("uid"))
        linked = _linked(sig := _matrix(table.column("sig")), sig, least)
        label = np.arange(len(uid))
        while True:
            new = np.where(linked, label[None, :], len(uid)).min(1)
            if (new == label).all():
                return [(int(uid[l]), int(u)) for l, u in zip(label, uid) if uid[l] != u]
            label = new

    return run


def _judged(members: DataFrame, sets: DataFrame, least: int) -> DataFrame:
    """(node, uid, pivot, near): every set of a large node against one of them, the pivot. Written."""
    pivots = members.groupBy("node").agg(F.min("uid").alias("pivot"))
    pivot_sig = pivots.join(sets.select(F.col("uid").alias("pivot"), F.col("sig").alias("pivot_sig")), "pivot")

    def same(a: pa.Array, b: pa.Array) -> pa.Array:
        return pa.array((_matrix(a) == _matrix(b)).sum(1) >= least)

    same.__annotations__ = {"a": pa.Array, "b": pa.Array, "return": pa.Array}
    wide = members.join(sets.select("uid", "sig"), "uid").join(pivot_sig, "node")
    return materialize(wide.select("node", "uid", "pivot", F.arrow_udf(same, "boolean")("sig", "pivot_sig").alias("near")), "pivots")


def _far_edges(judged: DataFrame, far: DataFrame, sets: DataFrame, block: int) -> Callable[[int], DataFrame]:
    """Star edges of what a pivot leaves against everyone of its node, block by block; far (node, m) names the nodes."""
    parts = lambda n: F.ceil(F.col(n) / F.lit(block)).cast("int")
    sizes = judged.join(far.select("node"), "node", "left_semi").groupBy("node").agg(F.count(F.lit(1)).alias("n"))
    placed = judged.join(far.join(sizes, "node"), "node").select("node", "uid", "near", F.pmod(F.xxhash64("uid"), parts("n")).cast("long").alias("j"), F.pmod(F.xxhash64("uid", F.lit(1)), parts("m")).cast("long").alias("i"), parts("n").cast("long").alias("js"), parts("m").cast("long").alias("is"))
    every = placed.join(sets.select("uid", "sig"), "uid")
    asking = every.where("not near").select("node", "i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("js") - 1)).alias("j"), "uid", "sig", F.lit(1).cast("long").alias("asks"))
    asked = every.select("node", F.explode(F.sequence(F.lit(0).cast("long"), F.col("is") - 1)).alias("i"), "j", "uid", "sig", F.lit(0).cast("long").alias("asks"))
    return lambda least: by_group(asking.unionByName(asked), ["node", "i", "j"], _forest(least), "a long, b long")


def _forest(least: int) -> Callable[[pa.Table], list[tuple]]:
    def run(table: pa.Table) -> list[tuple]:
        uid, asks, sig = np.asarray(table.column("uid")), np.asarray(table.column("asks")) == 1, _matrix(table.column("sig"))
        one, all_ = uid[asks], uid[~asks]
        x, y = np.nonzero(_linked(sig[asks], sig[~asks], least))
        label = {}  # a forest, so that no list of pairs leaves the block

        def top(u: int) -> int:
            while label.setdefault(u, u) != u:
                label[u] = u = label[label[u]]
            return u

        for a, b in zip(one[x].tolist(), all_[y].tolist()):
            a, b = top(a), top(b)
            if a != b:
                label[max(a, b)] = min(a, b)
        return [(top(u), u) for u in label if top(u) != u]

    return run


def components(edges: DataFrame) -> DataFrame:
    """(uid, label): the smallest uid of each vertex's component. Alternating stars, each round a written table."""

    def star(e: DataFrame, large: bool) -> DataFrame:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        near = both if large else both.where("b <= a")
        low = near.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("low"))
        out = near.join(low, "a")
        if large:
            return out.where("b > a and b <> low").select(F.col("low").alias("a"), "b").distinct()
        own = low.where("low < a").select(F.col("low").alias("a"), F.col("a").alias("b"))
        return out.where("b <> low").select(F.col("low").alias("a"), "b").unionByName(own).distinct()

    # an edge is (smaller, larger)
    now = materialize(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    mark = None
    while True:
        now = materialize(star(star(now, True), False), "edges")
        seen = tuple(now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if seen == mark or not seen[0]:
            break
        mark = seen
    return now.select(F.col("b").alias("uid"), F.col("a").alias("label")).unionByName(now.select(F.col("a").alias("uid"), F.col("a").alias("label")).distinct())


def _shared(x: np.ndarray, of_x: np.ndarray, y: np.ndarray, of_y: np.ndarray) -> np.ndarray:
    """Number of n-grams that each set of x shares with each of y, sets being distinct values between two offsets."""
    order = np.argsort(y)
    values, owner = y[order], np.repeat(np.arange(len(of_y) - 1), np.diff(of_y))[order]
    first = np.searchsorted(values, x, side="left")
    length = np.searchsorted(values, x, side="right") - first
    out = np.empty((len(of_x) - 1, len(of_y) - 1), np.int64)
    for i, (a, b) in enumerate(zip(of_x, of_x[1:])):
        out[i] = np.bincount(owner[R.ranges(first[a:b], length[a:b])], minlength=out.shape[1])
    return out


def _exact(classes: DataFrame, grams: DataFrame, threshold: float, block: int) -> DataFrame:
    """Links of the sets of each class (uid, label, texts) on their exact n-grams, block against block. Written table (a, b, n):
    edges of a forest of each two blocks (n = 0), and for a = b the texts of the sets linked to a in a block."""
    placed = classes.join(grams, "uid")
    blocks = F.greatest(F.ceil(F.count(F.lit(1)) / F.lit(block)), F.ceil(F.sum("size") / F.lit(block * _VOLUME)))
    sizes = classes.join(grams.select("uid", "size"), "uid").groupBy("label").agg(blocks.cast("int").alias("blocks"))
    placed = placed.join(sizes, "label").withColumn("own", F.pmod(F.xxhash64("uid"), F.col("blocks")).cast("long"))
    spread = placed.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), (F.col("blocks") - 1).cast("long"))))
    pairs = spread.select("label", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "own", "uid", "texts", "grams")

    def run(table: pa.Table) -> list[tuple]:
        table = table.sort_by("own")
        uid, own = np.asarray(table.column("uid")), np.asarray(table.column("own"))
        data, offsets, _ = text_buffer(table.column("grams"))
        flat, at = data.view(np.uint64), np.asarray(offsets) // 8
        size, alone = np.diff(at), table.column("lo")[0].as_py() == table.column("hi")[0].as_py()
        cut = len(uid) if alone else int(np.searchsorted(own, own[0], side="right"))
        if not alone and cut == len(uid):
            return []
        left, right = (slice(0, cut), slice(0, cut)) if alone else (slice(0, cut), slice(cut, len(uid)))
        to = at[right.start : right.stop + 1]
        both = _shared(flat[: at[cut]], at[: cut + 1], flat[to[0] : to[-1]], to - to[0])
        linked = both >= threshold * (size[left][:, None] + size[right][None, :] - both)
        if alone:
            np.fill_diagonal(linked, False)
        label = np.arange(len(uid))
        while True:
            new = label.copy()
            new[left] = np.minimum(new[left], np.where(linked, new[right][None, :], len(uid)).min(1))
            new[right] = np.minimum(new[right], np.where(linked, new[left][:, None], len(uid)).min(0))
            if (new == label).all():
                break
            label = new
        texts = np.asarray(table.column("texts"))
        counts = [*zip(uid[left], linked @ texts[right])] + ([] if alone else [*zip(uid[right], texts[left] @ linked)])
        return [(int(uid[l]), int(u), 0) for l, u in zip(label, uid) if uid[l] != u] + [(int(u), int(u), int(n)) for u, n in counts if n]

    return materialize(by_group(pairs, ["label", "lo", "hi"], run, "a long, b long, n long"), "exact")


def join(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", ngram: int = 5, threshold: float = 0.4, recall: float = 0.98, small: int = 64, deepest: int = DEPTH, block: int = 1024) -> DataFrame:
    """Per row: id, digest (md5 of the text), class_id (smallest id of its class), n_links, keeper (one (id, digest) a class)."""
    least = loosest(threshold)
    table = signatures(docs, id_col=id_col, text_col=text_col, ngram=ngram)
    keyed = table.where("n_words > 0")
    reps = keyed.groupBy("k1", "k2", "digest").agg(F.min("uid").alias("uid")).groupBy("k1", "k2").agg(F.min("uid").alias("uid"), F.count(F.lit(1)).alias("texts"))
    sets = materialize(keyed.join(reps.select("uid", "texts"), "uid").select("uid", "k1", "k2", "sig", "texts"), "sets")

    rows, found, buckets = _walk(sets, enough_runs(threshold, recall, least, deepest)), [], []
    for depth in range(DEPTH, deepest + 1):
        big = materialize(rows.groupBy("node").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > small).select("node"), "large")
        few = rows.join(big, "node", "left_anti").groupBy("node").agg(F.sort_array(F.collect_set("uid")).alias("m")).where(F.size("m") > 1)
        buckets.append(materialize(few.groupBy(F.xxhash64("m").alias("g")).agg(F.first("m").alias("m")), "buckets"))
        if big.isEmpty():
            break
        members = materialize(rows.join(big, "node", "left_semi").distinct(), "members")
        judged = _judged(members, sets, least)
        found.append(judged.where("near and uid <> pivot").select(F.col("pivot").alias("a"), F.col("uid").alias("b")).distinct())
        far = materialize(judged.where("not near").groupBy("node").agg(F.count(F.lit(1)).alias("m")), "far")
        ends = far if depth == deepest else far.where(F.col("m") <= small)
        if not ends.isEmpty():
            found.append(_far_edges(judged, ends, sets, block)(least))
        open_ = far.where(F.col("m") > small)
        if depth == deepest or open_.isEmpty():
            break
        rows = materialize(_deeper(members.join(open_.select("node"), "node", "left_semi"), sets), "paths")
    leaves = buckets[0]
    for b in buckets[1:]:
        leaves = leaves.unionByName(b)
    leaves = leaves.groupBy("g").agg(F.first("m").alias("m")).select("g", F.explode("m").alias("uid"))
    edges = by_group(leaves.join(sets.select("uid", "sig"), "uid"), ["g"], _star_edges(least), "a long, b long")
    for more in found:
        edges = edges.unionByName(more)

    loose = materialize(components(edges), "candidates")
    grams = gram_sets(docs, loose.join(table, "uid").select("uid", "digest"), text_col=text_col, ngram=ngram)
    exact = _exact(loose.join(sets.select("uid", "texts"), "uid"), grams, threshold, block)
    classes = materialize(components(exact.where("a <> b").select("a", "b")), "classes")
    degrees = exact.where("a = b").groupBy(F.col("a").alias("uid")).agg(F.sum("n").alias("n_links"))
    known = sets.select("k1", "k2", "uid", "texts").join(classes, "uid", "left").join(degrees, "uid", "left").select("k1", "k2", F.coalesce("label", "uid").alias("label"), (F.coalesce("n_links", F.lit(0)) + F.col("texts") - 1).cast("long").alias("n_links"))
    every = materialize(table.select("uid", "id", "digest", "n_words", "k1", "k2").join(known, ["k1", "k2"], "left").select("uid", "id", "digest", F.when(F.col("n_words") > 0, F.col("label")).otherwise(-1 - F.col("uid")).alias("label"), F.when(F.col("n_words") > 0, F.col("n_links")).otherwise(F.lit(0)).alias("n_links")), "linked")
    heads = every.groupBy("label").agg(F.min("id").alias("class_id"), F.min(F.struct(F.col("id").isNull().alias("none"), "id", "digest", "uid")).alias("head"))
    return every.join(heads, "label").select(F.col("id").alias(id_col), "digest", "class_id", "n_links", (F.col("uid") == F.col("head.uid")).alias("keeper"))


def representatives(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row of each class, the one with the smallest id, with the input's columns."""
    kept = join(docs, id_col=id_col, text_col=text_col, **options).where("keeper").select(F.col(id_col).alias("__id"), F.col("digest").alias("__digest"))
    c = lambda name: F.col(f"`{name}`")
    rows = docs.select(F.struct(*[c(x) for x in docs.columns]).alias("__row"), row_hash(docs).alias("__hash"), c(id_col).alias("__key"), F.md5(c(text_col).cast("binary")).alias("__text"))
    # a keeper is one row; rows equal to it in id and text are its copies, of which a hash of the other columns chooses
    counted = kept.groupBy("__id", "__digest").agg(F.count(F.lit(1)).alias("__n"))
    place = F.row_number().over(Window.partitionBy("__key", "__text").orderBy("__hash"))
    chosen = rows.join(counted, F.col("__key").eqNullSafe(F.col("__id")) & F.col("__text").eqNullSafe(F.col("__digest"))).withColumn("__place", place).where("__place <= __n")
    return chosen.select("__row.*")


def query(docs: DataFrame) -> DataFrame:
    return join(docs).select("doc_id", "class_id", "n_links")
