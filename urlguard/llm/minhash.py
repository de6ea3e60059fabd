"""Near-duplicate groups by MinHash with banding, signature checks and exact confirmation.

A document's set holds its distinct ``words``-word shingles (64-bit hashes; one shingle of the
whole sequence if it has fewer words). Equal sets form a class, and one document stands for it.
Universal hash functions give a signature; documents equal in all rows of a band share a bucket.

1. Every member of a bucket is paired with the bucket's smallest document. Pairs whose signatures
   agree too little are let go, the others are confirmed on full sets; links give components.
2. Buckets that hold members of more than one component are open. Their members are compared by
   signature, in blocks of bounded size; those that agree with a member of another component come
   together again with their full sets, and links that join components are found in place. Pairs
   inside a component cannot change it.

So no group's pairs are written out, and no link between different components is left unseen.
With the default 51 bands of 5 rows, a pair at similarity 0.75 shares no bucket with probability
1e-6; the signature check refuses such a pair with probability below 1e-6.

Null or blank text has an empty set and is linked with nothing. Rows that repeat a doc_id are one
node and end in one component. Rows with a null doc_id are linked like others, but a component is
named by its smallest non-null doc_id. If it has none, its smallest node stands for it: rows of equal
text, which share their node and ``kept``. ``without_copies`` leaves one row of those. An empty table
stays empty.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from urlguard.llm import spans
from urlguard.llm.common import let_go, private, stored, text_or_empty, text_slices
from urlguard.llm.components import components
from urlguard.operators.lookup import lookup

BANDS, ROWS, WORDS = 51, 5, 5
BLOCK = 256  # members of a bucket compared at once
BLOCK_SHINGLES = 1 << 21  # and the shingles of their sets (16 MB), about
CHUNK = 1 << 14  # shingles hashed at once
NODES_SENT = 1_000_000  # node ids (8 bytes each) that may be broadcast
WORD = r"[^\x20\x09-\x0D]"  # what a text with a word has
NAMELESS = 1 << 62  # nodes from here on stand for rows without doc_id


def shingle_sets(texts: list[str], words: int = WORDS) -> list[np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of each text. bytes.lower() changes A-Z only."""
    data, starts, ends, firsts = spans.words([t.encode().lower() for t in texts])
    hashes, edges = spans.span_hashes(data, starts, ends), firsts.tolist()

    def mixed(width: int, own: np.ndarray) -> np.ndarray:
        sums = np.full(max(0, len(own) - width + 1), width, np.uint64)
        for k in range(width):
            sums = sums * np.uint64(0xD1342543DE82EF95) + own[k : k + len(sums)]
        return spans.scramble(sums)

    every, found = mixed(words, hashes), []
    for start, end in zip(edges, edges[1:]):
        if end - start >= words:
            own = np.sort(every[start : end - words + 1])
            found.append(own[np.append(True, own[1:] != own[:-1])])
        else:  # one shingle of all words, or none
            found.append(mixed(end - start, hashes[start:end]) if end > start else np.zeros(0, np.uint64))
    return found


@functools.lru_cache(maxsize=2)
def _functions(count: int) -> tuple[np.ndarray, np.ndarray]:
    drawn = np.random.default_rng(42).integers(0, 1 << 32, (2, count), dtype=np.uint32)
    return drawn[0] | np.uint32(1), drawn[1]


def signatures(sets: list[np.ndarray], count: int) -> np.ndarray:
    """Low bytes of the minima of ``count`` functions a * x + b (mod 2^32), one row for each non-empty set."""
    factors, terms = _functions(count)
    minima = np.empty((len(sets), count), np.uint32)
    room = np.empty(max([CHUNK, *map(len, sets)]), np.uint32)
    start = 0
    while start < len(sets):
        end, held = start, 0
        while end < len(sets) and (end == start or held + len(sets[end]) <= CHUNK):
            held += len(sets[end])
            end += 1
        flat = (np.concatenate(sets[start:end]) >> np.uint64(32)).astype(np.uint32)
        at = np.cumsum([0, *map(len, sets[start : end - 1])])
        values = room[:held]
        for k in range(count):
            np.multiply(flat, factors[k], out=values)
            np.add(values, terms[k], out=values)
            minima[start:end, k] = np.minimum.reduceat(values, at)
        start = end
    return (minima & np.uint32(255)).astype(np.uint8)


def features(text: Column | str, words: int, count: int) -> Column:
    """Struct(n, hi, lo, sig): size and 128-bit hash of the set, and its signature (null if empty)."""

    @F.arrow_udf("n long, hi long, lo long, sig binary")
    def compute(texts: pa.Array) -> pa.Array:
        sizes, his, los, sigs = [], [], [], []
        for _, part in text_slices(texts):
            sets = shingle_sets(part, words)
            full = iter(signatures([s for s in sets if len(s)], count))
            for s in sets:
                digest = np.frombuffer(xxhash.xxh3_128_digest(s.tobytes()), "<i8")
                sizes.append(len(s))
                his.append(int(digest[0]))
                los.append(int(digest[1]))
                sigs.append(next(full).tobytes() if len(s) else None)
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary())
        columns = [pa.array(v, k) for v, k in zip((sizes, his, los, sigs), kinds)]
        return pa.StructArray.from_arrays(columns, ["n", "hi", "lo", "sig"])

    return compute(text_or_empty(text))


def _set_of(text: Column, words: int) -> Column:
    """Struct(hi, lo, set): a text's set and its 128-bit hash."""

    @F.arrow_udf("hi long, lo long, set binary")
    def compute(texts: pa.Array) -> pa.Array:
        found = [s.tobytes() for _, part in text_slices(texts) for s in shingle_sets(part, words)]
        digests = np.frombuffer(b"".join(xxhash.xxh3_128_digest(s) for s in found), "<i8").reshape(-1, 2)
        columns = [pa.array(digests[:, 0].copy()), pa.array(digests[:, 1].copy()), pa.array(found, pa.binary())]
        return pa.StructArray.from_arrays(columns, ["hi", "lo", "set"])

    return compute(text)


def _agreement(a: Column, b: Column) -> Column:
    """Equal places of two signatures."""

    @F.arrow_udf("int")
    def count(first: pa.Array, second: pa.Array) -> pa.Array:
        if not len(first):
            return pa.array([], pa.int32())
        x, y = (np.frombuffer(b"".join(s.to_pylist()), np.uint8).reshape(len(s), -1) for s in (first, second))
        return pa.array((x == y).sum(1), pa.int32())

    return count(a, b)


def _overlap(x: np.ndarray, y: np.ndarray) -> int:
    """Size of the intersection of two sorted sets that are not empty."""
    if len(x) > len(y):
        x, y = y, x
    at = np.minimum(np.searchsorted(y, x), len(y) - 1)
    return int((y[at] == x).sum())


def _common(a: Column, b: Column) -> Column:
    """Size of the intersection of two sorted sets."""

    @F.arrow_udf("long")
    def count(first: pa.Array, second: pa.Array) -> pa.Array:
        pairs = zip(first, second)
        sizes = [_overlap(*(np.frombuffer(v.as_buffer(), np.uint64) for v in pair)) for pair in pairs]
        return pa.array(sizes, pa.int64())

    return count(a, b)


BLOCK_KEY = ["bucket", "band", "i", "j"]
MEMBER = "bucket long, band int, i int, j int, own int, node long, c long, sig binary"


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, list[tuple]]]:
    """Runs of rows with the same first four values: one pair of blocks of a bucket each."""
    group, key = [], None
    for batch in batches:
        for row in zip(*(column.to_pylist() for column in batch.columns)):
            if row[:4] != key:
                if group:
                    yield key, group
                group, key = [], row[:4]
            group.append(row)
    if group:
        yield key, group


def _agreeing(key: tuple, group: list[tuple], rows: int, least: int) -> Iterator[tuple[int, np.ndarray]]:
    """A member and those of another component that agree with it enough and meet it here first."""
    _, band, i, j = key
    own, parts = np.array([g[4] for g in group]), np.array([g[6] for g in group])
    sigs = np.frombuffer(b"".join(g[7] for g in group), np.uint8).reshape(len(group), -1)
    second = np.flatnonzero(own == j)
    for x in np.flatnonzero(own == i).tolist():
        others = second[second > x] if i == j else second
        others = others[parts[others] != parts[x]]
        same = sigs[others] == sigs[x]
        enough = same.sum(1) >= least
        others, same = others[enough], same[enough]
        if band and len(others):  # an earlier shared band has seen the pair
            others = others[~same[:, : band * rows].reshape(len(others), band, rows).all(2).any(1)]
        if len(others):
            yield x, others


def _suspects(rows: int, least: int):
    """Of each pair of blocks the members that agree with one of another component."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int64(), *[pa.int32()] * 4, pa.int64(), pa.int64(), pa.binary())
        names = [field.split()[0] for field in MEMBER.split(", ")]
        for key, group in _groups(batches):
            found: set[int] = set()
            for x, others in _agreeing(key, group, rows, least):
                found.add(x)
                found.update(others.tolist())
            if found:
                columns = zip(*(group[k] for k in sorted(found)))
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)
        let_go()

    return run


def _joining(rows: int, least: int, percent: int):
    """Of each pair of blocks, links that are enough to join what any of its links joins.

    Rows carry the full set last. Once two components are joined here, their other pairs are
    passed over.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, group in _groups(batches):
            sets = [np.frombuffer(g[8], np.uint64) for g in group]
            joined: dict[int, int] = {}

            def root(c: int) -> int:
                while (up := joined.get(c, c)) != c:
                    c = up
                return c

            links = []
            for x, others in _agreeing(key, group, rows, least):
                for y in others.tolist():
                    a, b = root(group[x][6]), root(group[y][6])
                    if a == b:
                        continue
                    common = _overlap(sets[x], sets[y])
                    if common * 100 >= (len(sets[x]) + len(sets[y]) - common) * percent:
                        joined[max(a, b)] = min(a, b)
                        links.append((group[x][5], group[y][5]))
            if links:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*links)], ["u", "v"])
        let_go()

    return run


def node_of(doc_id: Column | str, text: Column | str) -> Column:
    """Names a row: its doc_id, or the hash of its text if that is null."""
    doc_id = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(doc_id.cast("long"), F.shiftrightunsigned(F.xxhash64(text), 2) + F.lit(NAMELESS))


def grouped(
    documents: DataFrame, percent: int = 75, words: int = WORDS, bands: int = BANDS, rows: int = ROWS
) -> DataFrame:
    """doc_id, node, n_shingles, component_id and kept for each row of documents (doc_id, text)."""
    count = bands * rows
    # Five standard deviations below the threshold.
    least = int(count * percent / 100 - 5 * (count * percent / 100 * (1 - percent / 100)) ** 0.5)
    node = node_of("doc_id", "text").alias("node")
    given = documents.select(F.col("doc_id").cast("long"), node, text_or_empty("text").alias("text"))
    marked = given.select("doc_id", "node", features("text", words, count).alias("f"))
    held = stored(marked.select("doc_id", "node", "f.*"), "signatures")

    # A node with several sets has its home in one class; its other classes are linked with that one.
    full = held.where("n > 0")
    homes = full.groupBy("node").agg(F.min(F.struct("hi", "lo")).alias("home"), F.max(F.struct("hi", "lo")).alias("other"), F.count("*").alias("rows"))
    homes = stored(homes, "homes")
    several = homes.where("home != other").select("node", "home")
    homed = lookup(full.select("node", "hi", "lo"), several, "node", "left")
    at_home = F.col("home").isNull() | (F.col("home") == F.struct("hi", "lo"))
    named = homed.groupBy("hi", "lo").agg(F.min(F.when(at_home, F.col("node"))).alias("rep"), F.min("node").alias("carrier"))
    # A class that is home to no node gets a number of its own.
    number = F.shiftrightunsigned(F.xxhash64("hi", "lo"), 2) + F.lit(NAMELESS)
    classes = stored(named.select("hi", "lo", F.coalesce("rep", number).alias("rep"), "carrier"), "classes")
    away = homed.where(~at_home).distinct().join(classes, ["hi", "lo"]).select("home", F.col("rep").alias("u"))
    home_of = classes.select(F.struct("hi", "lo").alias("home"), F.col("rep").alias("v"))
    shared = away.join(home_of, "home").select("u", "v").distinct()
    stands = classes.select("hi", "lo", F.col("carrier").alias("node"), "rep")
    reps = full.select("hi", "lo", "node", "n", "sig").join(stands, ["hi", "lo", "node"])
    reps = stored(reps.select(F.col("rep").alias("node"), "n", "sig").distinct(), "reps")

    places = F.array(*[F.struct(F.lit(k).alias("band"), F.substring("sig", k * rows + 1, rows).alias("part")) for k in range(bands)])
    banded = reps.select("node", F.explode(places).alias("p"))
    banded = banded.select(F.xxhash64("p.band", "p.part").alias("bucket"), F.col("p.band").alias("band"), "node")
    leads = banded.groupBy("bucket").agg(F.min("node").alias("lead"), F.max("node").alias("last"), F.count("*").alias("size"))
    members = stored(lookup(banded, leads.where("lead != last"), "bucket", "inner"), "members")

    involved = members.select(F.col("node").alias("rep")).distinct().join(classes, "rep")
    involved = stored(involved.select(F.col("carrier").alias("node"), "rep", F.col("hi").alias("own_hi"), F.col("lo").alias("own_lo")), "involved")
    if involved.count() <= NODES_SENT:
        involved = F.broadcast(involved)
    read = given.select("node", "text").join(involved, "node").select("node", "rep", "own_hi", "own_lo", _set_of(F.col("text"), words).alias("s"))
    # Filtered when written: a filter on what Python gives would have it work twice.
    read = stored(read.select("node", "rep", "own_hi", "own_lo", "s.*"), "sets-read").where("hi = own_hi AND lo = own_lo")
    # Rows that repeat a document bring its set once.
    repeated = homes.where("rows > 1").select("node")
    once = read.join(repeated, "node", "left_anti").select("rep", "set")
    more = read.join(repeated, "node", "left_semi").dropDuplicates(["rep"]).select("rep", "set")
    sets = once.unionAll(more).withColumnRenamed("rep", "node")

    def confirmed(pairs: DataFrame) -> DataFrame:
        """Links (u, v) among pairs (a, b)."""
        with_a = pairs.join(sets.select(F.col("node").alias("a"), F.col("set").alias("set_a")), "a")
        with_b = with_a.join(sets.select(F.col("node").alias("b"), F.col("set").alias("set_b")), "b")
        sized = with_b.select(
            "a", "b", (F.octet_length("set_a") + F.octet_length("set_b")).alias("total"), _common(F.col("set_a"), F.col("set_b")).alias("common")
        )
        linked = F.col("common") * 100 >= (F.floor(F.col("total") / 8) - F.col("common")) * percent
        return stored(sized.where(linked).select(F.col("a").alias("u"), F.col("b").alias("v")), "links")

    led = members.where("node != lead").select(F.col("lead").alias("a"), F.col("node").alias("b")).distinct()
    signed = led.join(reps.select(F.col("node").alias("a"), F.col("sig").alias("sig_a")), "a")
    signed = signed.join(reps.select(F.col("node").alias("b"), F.col("sig").alias("sig_b")), "b")
    # Written down, so that no task has workers for both comparisons.
    agreeing = stored(signed.where(_agreement(F.col("sig_a"), F.col("sig_b")) >= least).select("a", "b"), "agreeing")
    links = confirmed(agreeing)
    links = stored(links.unionAll(shared), "links")
    parts = components(links)

    # Open buckets: members of several components besides the smallest, whose pairs are done.
    rest = members.where("size > 2 and node != lead").select("bucket", "band", "node")
    placed = rest.join(parts, "node", "left").join(reps.select("node", "n"), "node")
    placed = stored(placed.select("bucket", "band", "node", "n", F.coalesce("component", "node").alias("c")), "placed")
    spread = placed.groupBy("bucket").agg(F.min("c").alias("c1"), F.max("c").alias("c2"), F.count("*").alias("size"), F.sum("n").alias("shingles"))
    blocks = F.ceil(F.greatest(F.col("size") / BLOCK, F.col("shingles") / BLOCK_SHINGLES)).cast("int")
    open_buckets = spread.where("c1 != c2").select("bucket", blocks.alias("blocks"))
    opened = lookup(placed.drop("n"), open_buckets, "bucket", "inner").join(reps.drop("n"), "node")
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    dealt = opened.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select(
        "bucket", "band", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "node", "c", "sig"
    )

    def blocks_of(frame: DataFrame) -> DataFrame:
        return frame.repartition("bucket", "i", "j").sortWithinPartitions(*BLOCK_KEY, "node")

    suspects = stored(blocks_of(dealt).mapInArrow(_suspects(rows, least), MEMBER), "suspects")
    armed = blocks_of(suspects.join(sets, "node").select(*suspects.columns, "set"))
    more = stored(armed.mapInArrow(_joining(rows, least, percent), "u long, v long"), "links")
    parts = components(links.unionAll(more))

    roots = classes.join(parts.withColumnRenamed("node", "rep"), "rep", "left")
    roots = roots.select("hi", "lo", F.coalesce("component", "rep").alias("root"))
    roots = stored(roots, "roots")
    rooted = full.join(roots, ["hi", "lo"])
    # An empty row of a document that has a set as well goes with it.
    home_root = homes.join(roots.select(F.struct("hi", "lo").alias("home"), "root"), "home").select("node", "root")
    empty = lookup(held.where("n = 0"), home_root, "node", "left").withColumn("root", F.coalesce("root", "node"))
    every = rooted.select("doc_id", "node", "n", "root").unionAll(empty.select("doc_id", "node", "n", "root"))
    return every.select(
        "doc_id", "node", F.col("n").alias("n_shingles"),
        F.when(F.col("root") < NAMELESS, F.col("root")).alias("component_id"), (F.col("node") == F.col("root")).alias("kept"),
    )


def near_duplicates(documents: DataFrame, *args, **settings) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for each row of documents (doc_id, text)."""
    return grouped(documents, *args, **settings).drop("node")


def without_copies(documents: DataFrame, *args, **settings) -> DataFrame:
    """The documents that are kept, with all their columns; of nameless rows of equal text one.

    Rows that repeat a doc_id stay or go together. Rows without a word are copies of nothing.
    """
    node, mark = private("node", "mark")
    columns = documents.columns
    gone = grouped(documents.select("doc_id", "text"), *args, **settings).where("not kept")
    gone = stored(gone.select(F.col("node").alias(node)).distinct(), "gone")
    left = documents.withColumn(node, node_of("doc_id", "text")).join(gone, node, "left_anti")
    has_words = F.coalesce(F.col("text").rlike(WORD), F.lit(False))
    alone = left.where(F.col("doc_id").isNotNull() | ~has_words).select(*columns)
    equal = left.where(F.col("doc_id").isNull() & has_words).groupBy(node)
    first = equal.agg(F.min_by(F.struct(*columns), F.xxhash64(*columns)).alias(mark))
    return alone.unionAll(first.select(f"{mark}.*"))


CHECK_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws
  FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
    ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i : i + 4], ' ')) END) AS sh
  FROM w),
n AS (SELECT w.doc_id, count(s.sh) AS n FROM w LEFT JOIN s ON w.doc_id = s.doc_id GROUP BY w.doc_id),
p AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS m FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY ALL),
e AS (
  SELECT u, v FROM p JOIN n a ON a.doc_id = u JOIN n b ON b.doc_id = v WHERE 100 * m >= 75 * (a.n + b.n - m)),
d AS (SELECT u, v FROM e UNION ALL SELECT v, u FROM e),
r AS (SELECT doc_id, doc_id AS c FROM w UNION SELECT d.v, r.c FROM r JOIN d ON d.u = r.doc_id),
c AS (SELECT doc_id, min(c) AS component_id FROM r GROUP BY doc_id)
SELECT n.doc_id, n.n AS n_shingles, component_id, n.doc_id = component_id AS kept FROM n JOIN c ON n.doc_id = c.doc_id"""
