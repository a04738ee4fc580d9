"""SimHash near-duplicates: 64-bit fingerprints linked within a Hamming distance by multi-index hashing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from ..operators.components import components
from .common import name, saved, text_or_empty, unfold, whole_rows

DISTANCE, SHINGLE, SEED = 3, 3, 42
#: Of `keep_unlike`: words of a shingle, words of a run, segments of the runs' fingerprint, bits by which two of these
#: fingerprints may differ (of 256), bits of the parities, and rounds that compare with two rows of each slot, at most.
SIMILAR_SHINGLE, RUN, SEGMENTS, RADIUS, PARITIES, ROUNDS = 5, 2, 8, 80, 1024, 8
#: Bits of a segment. It decides which texts meet, so it is the same for every corpus.
WIDTH = 16


def fingerprint(text: Column, shingle: int = SHINGLE, seed: int = SEED) -> Column:
    """The fingerprint of each text as a signed 64-bit number, in Arrow batches.

    A-Z is lower-cased; the shingles are all runs of ``shingle`` words (joined by single spaces, repeats included;
    with fewer words, the whole sequence), hashed by XXH64. A bit is 1 if more than half of the hashes have it.
    A text without words gets 0.
    """
    @pandas_udf("bigint")
    def of(texts):
        import numpy as np
        import pandas as pd
        from xxhash import xxh64_intdigest
        made = np.zeros(len(texts), dtype=np.uint64)
        for i, t in enumerate(texts):
            parts = t.encode("utf-8", "surrogatepass").lower().split()   # bytes: ASCII letters and white space only
            if not parts:
                continue
            joined, n = b" ".join(parts), max(1, len(parts) - shingle + 1)
            ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1)
            starts = (ends - np.fromiter(map(len, parts), np.int64, len(parts)) - 1)[:n].tolist()
            stops = (ends - 1)[-n:].tolist()
            votes = np.zeros(64, dtype=np.int64)
            for at in range(0, n, 65536):     # bounded memory for any length
                block = np.fromiter((xxh64_intdigest(joined[a:b], seed) for a, b in zip(starts[at:at + 65536], stops[at:at + 65536])),
                                    np.uint64, min(65536, n - at))
                votes += np.unpackbits(block.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
            made[i] = np.packbits(2 * votes > n, bitorder="little").view("<u8")[0]
        return pd.Series(made.view(np.int64))
    return of(text)


def links(prints: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """All pairs ``a < b`` of the distinct numbers in ``fp`` that differ in 1 to ``distance`` bits.

    The number is cut into segments so that two numbers within the distance agree in one segment up to one bit
    (two halves for a distance of 2 or 3). One side looks up its segments as they are, the other every
    segment with one of its set bits cleared as well: of two segments that differ in one bit, just one can
    be cleared into the other. Whole distances are verified before anything leaves the join.
    """
    segments = distance // 2 + 1
    width = 64 // segments
    cuts = [(k, k * width, width if k < segments - 1 else 64 - k * width) for k in range(segments)]

    def part(start, bits):
        shifted = F.shiftrightunsigned("fp", start)
        return shifted if bits == 64 else shifted.bitwiseAND(F.lit((1 << bits) - 1))

    entries = prints.select("fp", F.explode(F.array(*[F.struct(F.lit(k).alias("segment"), part(s, b).alias("value")) for k, s, b in cuts])).alias("e"))
    table = entries.select(F.col("fp").alias("b"), F.col("e.segment").alias("segment"), F.col("e.value").alias("value"))
    widest = max(b for _, _, b in cuts)
    near = F.expr(f"""concat(array(e.value), transform(filter(sequence(0, {widest - 1}),
        i -> (shiftright(e.value, i) & 1L) = 1L), i -> e.value - shiftleft(1L, i)))""")
    probes = entries.select(F.col("fp").alias("a"), F.col("e.segment").alias("s"), F.explode(near).alias("v"))
    apart = F.bit_count(F.col("a").bitwiseXOR(F.col("b")))
    # probes are many times the entries, which size estimates overlook: the join must not be broadcast
    met = probes.join(table.hint("merge"), (F.col("s") == F.col("segment")) & (F.col("v") == F.col("value"))
                      & (F.col("a") != F.col("b")) & (apart <= distance))
    return met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def near_groups(df: DataFrame, key: str = "doc_id", text: str = "text", distance: int = DISTANCE) -> DataFrame:
    """Add ``fingerprint`` (16 hex digits) and ``component_id`` to every row.

    ``component_id`` is the smallest key of all rows that are reachable over fingerprints within the distance, or
    null if none of them has a key. Rows with one fingerprint meet in a grouped minimum before any link is
    looked for, so thousands of copies cost one entry. A null text is empty, and texts without words share the
    fingerprint 0, which is linked like any other. An empty table gives an empty table.
    """
    prints = df.select(name(key).alias("id"), fingerprint(text_or_empty(text)).alias("fp"))
    prints = saved(prints.withColumn("at", F.monotonically_increasing_id()), "simhash")
    roots = saved(_roots(prints, distance), "simhash-roots")
    return prints.join(roots, F.col("fp") == F.col("f")).select(
        F.col("id").alias(key), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("least.id").alias("component_id"))


def _roots(prints: DataFrame, distance: int) -> DataFrame:
    """``f`` (a fingerprint) and ``least`` (key and row of the first member of its component: rows without a
    key come last), from rows of ``id fp at``."""
    member = F.struct(F.col("id").isNull().alias("n"), "id", "at")
    firsts = saved(prints.groupBy("fp").agg(F.min(member).alias("first")), "simhash-distinct")
    found = components(links(firsts.select("fp"), distance), keep=saved)
    rooted = firsts.join(found, F.col("fp") == F.col("node"), "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("first").alias("least")).select(F.col("root").alias("r"), "least")
    return rooted.join(least, F.col("root") == F.col("r")).select(F.col("fp").alias("f"), "least")


def keep_first(df: DataFrame, key: str = "doc_id", text: str = "text", distance: int = DISTANCE) -> DataFrame:
    """One row of each group of near-duplicates, with the columns of the frame: the one with the smallest key
    (rows without a key come last; of rows that share it, exactly one stays).

    A null text is empty, and texts without words are alike; repeated rows are one group; a text of any length is hashed in
    blocks. An empty table gives an empty table. Helper columns cannot clash with the frame's.
    """
    rows = df.select(whole_rows(df).alias("row"), name(key).alias("id"), fingerprint(text_or_empty(text)).alias("fp"))
    rows = saved(rows.withColumn("at", F.monotonically_increasing_id()), "simhash-rows")
    stay = _roots(rows.select("id", "fp", "at"), distance).select(F.col("least.at").alias("a")).distinct()
    return unfold(rows.join(stay, F.col("at") == F.col("a"), "left_semi"), "row", df.columns, [], [])


def sketches(text: Column, shingle: int = SIMILAR_SHINGLE, run: int = RUN, seed: int = SEED) -> Column:
    """What `keep_unlike` needs of each text, in Arrow batches.

    ``fps`` is a fingerprint of 256 bits (four numbers) of the runs of ``run`` words, of which the segments are cut. Of the set
    of shingles, hashed by XXH64, ``n`` is the size, ``digest`` a hash, and ``odd`` says for each of 1,024 residues whether an odd
    number of hashes has it: two sets differ in at least as many shingles as their parities do in bits.
    """
    @pandas_udf("fps array<bigint>, n int, odd array<bigint>, digest binary")
    def of(texts):
        import numpy as np
        import pandas as pd
        from xxhash import xxh3_128_digest, xxh64_digest

        def majority(blocks, bits):
            votes, n = np.zeros(bits, dtype=np.int64), 0
            for block in blocks:
                votes += np.unpackbits(block.view(np.uint8).reshape(len(block), -1), axis=1).sum(axis=0, dtype=np.int64)
                n += len(block)
            return np.packbits(2 * votes > n).view("<i8")

        def widened(h):                       # as many numbers more of each hash
            more = (h ^ (h[:, ::-1] >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)
            return np.hstack([h, more ^ (more >> np.uint64(32))])

        made = []
        for t in texts:
            parts = t.encode("utf-8", "surrogatepass").lower().split()
            joined = b" ".join(parts)
            sizes = np.fromiter(map(len, parts), np.int64, len(parts))
            ends = np.cumsum(sizes + 1) - 1
            begins = (ends - sizes).tolist()
            ends = ends.tolist()

            def hashed(length, digest):       # bounded memory for any length
                n = max(1, len(parts) - length + 1) if parts else 0
                last = ends[-n:] if n else []
                for at in range(0, n, 65536):
                    yield b"".join([digest(joined[a:b], seed) for a, b in zip(begins[at:min(n, at + 65536)], last[at:at + 65536])])

            fps = majority((widened(np.frombuffer(b, "<u8").reshape(-1, 2)) for b in hashed(run, xxh3_128_digest)), 256)
            held = np.unique(np.frombuffer(b"".join(hashed(shingle, xxh64_digest)), ">u8"))
            odd = np.bincount((held % PARITIES).astype(np.int64), minlength=PARITIES) & 1
            made.append((fps, len(held), np.packbits(odd.astype(np.uint8)).view("<i8"), xxh3_128_digest(held.tobytes())))
        return pd.DataFrame(made, columns=["fps", "n", "odd", "digest"])
    return of(text)


def similar(a: Column, b: Column, shingle: int = SIMILAR_SHINGLE) -> Column:
    """Whether the sets of shingles of two texts have a Jaccard similarity of 0.8 or more (two empty sets have).

    Pairs that come sorted by the first text have its set built once for all of them."""
    @pandas_udf("boolean")
    def of(left, right):
        import pandas as pd

        def held(t):
            w = t.encode("utf-8", "surrogatepass").lower().split()
            return {b" ".join(w[i:i + shingle]) for i in range(max(1, len(w) - shingle + 1))} if w else set()

        made, last, x = [], None, set()
        for one, other in zip(left, right):
            if one != last:
                last, x = one, held(one)
            y = held(other)
            shared = len(x & y)
            made.append(5 * shared >= 4 * (len(x) + len(y) - shared))
        return pd.Series(made, dtype=bool)
    return of(a, b)


#: What a row of a slot carries: its text and component, and what is compared inside the join.
WORDS, PARTS = ["f0", "f1", "f2", "f3"], ["p0", "p1", "p2", "p3"]
CARRIED = ["at", "root", "n", *WORDS, *PARTS]


def _entries(nodes: DataFrame, width: int) -> DataFrame:
    """A row per node and segment: ``base`` numbers the segment, ``value`` holds its ``width`` bits."""
    segments = [F.struct(F.lit(k << width).alias("base"), _segment(F.col(WORDS[k // 2]), k, width).alias("value")) for k in range(SEGMENTS)]
    return nodes.select(*CARRIED, F.explode(F.array(*segments)).alias("e")).select(*CARRIED, "e.base", "e.value")


def _segment(word: Column, k: int, width: int) -> Column:
    return F.shiftrightunsigned(word, 32 * (k % 2)).bitwiseAND(F.lit((1 << width) - 1))


def _alike() -> Column:
    """Whether a row of `CARRIED` and a `_renamed` one may be similar: sizes of sets that allow 0.8, whole fingerprints within the radius, and parities
    of 256 residues that allow 0.8 (a similarity of 0.8 leaves a ninth of both sizes together as difference)."""
    def bits(names):
        return sum((F.bit_count(F.col(c).bitwiseXOR(F.col(f"{c}_b"))) for c in names), F.lit(0))

    return ((F.col("root") != F.col("root_b")) & (5 * F.least("n", "n_b") >= 4 * F.greatest("n", "n_b"))
            & (9 * bits(PARTS) <= F.col("n") + F.col("n_b")) & (bits(WORDS) <= RADIUS))


def _renamed(rows: DataFrame) -> DataFrame:
    return rows.select(F.col("slot").alias("slot_b"), *[F.col(c).alias(f"{c}_b") for c in CARRIED])


def _ordered(met: DataFrame) -> DataFrame:
    return met.select(F.least("at", "at_b").alias("a"), F.greatest("at", "at_b").alias("b"))


def _with_two(nodes: DataFrame, width: int, seed: int) -> DataFrame:
    """Pairs of each node with two rows of each of its slots (equal segments), drawn anew by each seed: no more than
    twice nodes times segments, however large a slot is.

    One is drawn among the rows, so most likely of the slot's largest component, the other among the components."""
    entries = _entries(nodes, width).withColumn("slot", F.col("base") + F.col("value"))
    by_row = F.struct(F.xxhash64(F.lit(seed), "at").alias("draw"), *CARRIED)
    by_root = F.struct(F.xxhash64(F.lit(seed), "root").alias("draw"), *CARRIED)
    drawn = entries.groupBy("slot").agg(F.min(by_row).alias("x"), F.max(by_root).alias("y"), F.min("root").alias("from"), F.max("root").alias("to"))
    drawn = drawn.where("from < to").select("slot", F.explode(F.array_distinct(F.array(*[
        F.struct(*[F.col(d)[c].alias(c) for c in CARRIED]) for d in "xy"]))).alias("one"))
    # a slot's draw is a table of its own, so that the join can split a large slot
    drawn = saved(drawn.select("slot", "one.*"), "near-drawn")
    return _ordered(entries.join(_renamed(drawn).hint("merge"), (F.col("slot") == F.col("slot_b")) & _alike())).distinct()


def _rest(nodes: DataFrame, width: int) -> DataFrame:
    """All pairs of different roots that agree in a segment up to one bit and are alike, each of them once.

    One side looks its segments up as they are, the other with one set bit cleared as well. A pair leaves the join in the first
    segment where it meets, however many it has."""
    entries = _entries(nodes, width)
    table = entries.select(*CARRIED, (F.col("base") + F.col("value")).alias("slot"))
    ball = F.expr(f"""concat(array(value), transform(filter(sequence(0, {width - 1}), i -> (shiftright(value, i) & 1L) = 1L),
        i -> value - shiftleft(1L, i)))""")
    probes = entries.select(*CARRIED, "base", F.explode(ball).alias("v")).select(*CARRIED, (F.col("base") + F.col("v")).alias("slot"))
    first, own = F.lit(True), F.lit(0)
    for k in range(SEGMENTS):
        apart = F.bit_count(_segment(F.col(WORDS[k // 2]).bitwiseXOR(F.col(f"{WORDS[k // 2]}_b")), k, width))
        here = F.shiftright("slot", width)
        first = first & ((here <= k) | (apart > 1))
        # of equal segments either side looks up the other
        own = F.when(here == k, apart).otherwise(own)
    first = first & ((own > 0) | (F.col("at") < F.col("at_b")))
    return _ordered(probes.join(_renamed(table).hint("merge"), (F.col("slot") == F.col("slot_b")) & _alike() & first))


def _confirmed(pairs: DataFrame, nodes: DataFrame, rows: DataFrame, text: str) -> DataFrame:
    """The pairs ``a b`` whose parities and then whole sets of shingles leave a similarity of 0.8, as a written table."""
    pairs = saved(pairs, "near-candidates")
    left = nodes.select(F.col("at").alias("a"), F.col("n").alias("n_a"), F.col("odd").alias("odd_a"))
    right = nodes.select(F.col("at").alias("b"), F.col("n").alias("n_b"), F.col("odd").alias("odd_b"))
    apart = F.aggregate(F.zip_with("odd_a", "odd_b", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda x, y: x + y)
    # a similarity of 0.8 leaves a ninth of both sizes together as difference
    pairs = saved(pairs.join(left, "a").join(right, "b").where(9 * apart <= F.col("n_a") + F.col("n_b")).select("a", "b"), "near-pairs")
    met = pairs.select(F.col("a").alias("at")).unionByName(pairs.select(F.col("b").alias("at"))).distinct()
    texts = saved(rows.join(met, "at", "left_semi").select("at", F.coalesce(F.col("row")[text].cast("string"), F.lit("")).alias("t")), "near-texts")
    both = pairs.join(texts.select(F.col("at").alias("b"), F.col("t").alias("u")), "b").join(texts.select(F.col("at").alias("a"), "t"), "a")
    return saved(both.where(similar(F.col("t"), F.col("u"))).select("a", "b"), "near-links")


def _rooted(nodes: DataFrame, found: list[DataFrame]) -> DataFrame:
    links = found[0]
    for more in found[1:]:
        links = links.unionByName(more)
    roots = components(links, keep=saved).select("node", F.col("root").alias("to"))
    return nodes.drop("root").join(roots, F.col("at") == F.col("node"), "left").withColumn("root", F.coalesce("to", "at")).drop("node", "to")


def keep_unlike(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each group of texts that are linked by a Jaccard similarity of 0.8 or more of their 5-word shingles, with
    the columns of the frame: the one with the smallest key (rows without a key come last; of rows that share it, exactly one stays).

    Texts meet in slots: eight segments of 16 bits of a fingerprint over runs of two words, with their one-bit balls, so which texts meet
    does not depend on the others; a slot holds more of them in a larger corpus. Pairs are verified inside the join by
    parities of 256 residues of their shingles and their whole fingerprints (80 of 256 bits), then by 1,024 parities, and confirmed by
    their whole sets, so no unlike text goes; what no segment brings together stays. First, each slot compares all its texts with two of
    them, and what is confirmed is joined, again with another draw while that confirms a pair for every hundred texts; then every pair of
    a slot that is not joined yet is looked at, once however many slots it shares. Texts of a large group that are joined by then cost
    the group's size, not its square; texts that lie around it and are not like it are compared with all its texts in their slots. Texts with equal sets meet in a grouped minimum before that. A-Z is
    lower-cased; a text of fewer than five words is one shingle; a null text is empty, and texts without words are alike. An empty
    table gives an empty table. Helper columns cannot clash with the frame's.
    """
    rows = df.select(whole_rows(df).alias("row"), name(key).alias("id"), text_or_empty(text).alias("t"))
    rows = rows.select("row", "id", sketches(F.col("t")).alias("of"), F.monotonically_increasing_id().alias("at"))
    rows = saved(rows.select("row", "id", "at", "of.*"), "near-rows")
    member = F.struct(F.col("id").isNull().alias("null"), "id", "at")
    nodes = rows.groupBy("digest").agg(F.min(member).alias("first")).select("first", F.col("first.at").alias("first_at"))
    nodes = nodes.join(rows.select("at", "fps", "n", "odd"), F.col("first_at") == F.col("at"))
    each = PARITIES // 64 // len(PARTS)
    folded = [F.aggregate(F.slice("odd", 1 + each * k, each), F.lit(0).cast("bigint"), lambda x, y: x.bitwiseXOR(y)).alias(c)
              for k, c in enumerate(PARTS)]
    words = [F.col("fps")[k].alias(c) for k, c in enumerate(WORDS)]
    nodes = saved(nodes.select("first", "at", *words, "n", "odd", *folded, F.col("at").alias("root")), "near-nodes")
    texts = nodes.count()
    found, rooted = [], nodes
    for seed in range(ROUNDS):
        found.append(_confirmed(_with_two(rooted, WIDTH, seed), nodes, rows, text))
        rooted = saved(_rooted(nodes, found), "near-rooted")
        if 100 * found[-1].count() < texts:
            break
    found.append(_confirmed(_rest(rooted, WIDTH), nodes, rows, text))
    least = _rooted(nodes, found).groupBy("root").agg(F.min("first").alias("least")).select(F.col("least.at").alias("a"))
    return unfold(rows.join(least, F.col("at") == F.col("a"), "left_semi"), "row", df.columns, [], [])
