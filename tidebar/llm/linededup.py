"""Line dedup by a segment-partition edit join, in DataFrame expressions alone.

Texts are split at line ends. A line of MIN_CHARS characters or more is removed where an earlier line of any document
(by doc_id, then by place) equals it or is within THRESHOLD edits of it. Of shorter lines that are not blank the exact
repeats go too where `short_repeats` is set, as op10 and the pipeline do, and else they stay; the rest of the text
stays as it is. A line is cut into THRESHOLD + 1 segments, of which any line within the threshold must contain one
unchanged, within a known shift: lines are indexed by (length, segment number, segment) and probe the substrings that
the length difference allows. Only the hashed keys are counted, so copies of a line meet in partial aggregation. Lines
under a key that different lines share are then gathered in tiles of bounded size, once a key that many share has been
refined by segments of the rest of the line, and a tile yields the lines that have an earlier one within the threshold,
by banded bit-parallel edit distance, never its pairs. Only hashes and places are joined, and the texts of lines that
share a key; the removed places of a document go to it at the end.

Defined results: a null text stays null and has no lines; rows with equal doc_id and text are one document and get the
same result; a null doc_id comes after all others; of equal lines in one document the first stays; an empty table gives
an empty table; a document whose lines all go keeps its row with an empty text; a line of any length is compared whole;
other columns pass through, whatever their names, but columns n_lines and n_removed are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidebar.llm.hot import join_hot
from tidebar.session import forget, written

THRESHOLD = 2
MIN_CHARS = 40
#: Lines on either side of a tile, about.
TILE = 64
#: Pieces of a line that are looked for in another before their distance is computed.
PIECES = 24
#: Every so manieth piece is looked for first; and so many pieces are cut out of one part of a line.
SAMPLED = 3
PART = 6
#: Lines under one key from which on it is refined by segments of what remains of them.
REFINED = 256
#: Keys that are broadcast at most (8 bytes each); beyond it they are joined by shuffling.
BROADCAST_KEYS = 500_000
_TOP = 20


def _let(value: Column, body) -> Column:
    """body(value) with value evaluated once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def within_edits(a: Column, b: Column, threshold: int = THRESHOLD) -> Column:
    """Whether the edit distance of two strings is at most the threshold.

    Between the common prefix and suffix, each character of b is one step of a bit-vector of 2 * threshold + 1 diagonals: bit _TOP
    is the lowest row of the band, and `score` is the distance there, then along the last row of a.
    """
    everything = (1 << _TOP + 1) - 1
    powers = F.array(*[F.lit(1 << i) for i in range(24, -1, -1)])

    def prefix(x: Column, y: Column) -> Column:
        def doubled(most: Column) -> Column:
            return F.aggregate(
                F.filter(powers, lambda p: p <= most),
                F.lit(0),
                lambda done, p: F.when((done + p <= most) & (F.substring(x, done + 1, p) == F.substring(y, done + 1, p)), done + p).otherwise(done),
            )

        return _let(F.least(F.length(x), F.length(y)), doubled)

    def chars(x: Column) -> Column:
        return F.when(x == "", F.array().cast("array<string>")).otherwise(F.split(x, ""))

    def distance(s: Column) -> Column:
        p, t, m, n = s["p"], s["t"], s["m"], s["n"]
        limit = F.lit(2 * threshold) + n - m

        def step(state: Column, letter: Column) -> Column:
            j = state["j"]
            match = F.lit(0).cast("long")
            for k in range(2 * threshold + 1):
                match = match + F.when(F.get(p, j + (threshold - k - 1)) == letter, F.lit(1 << _TOP - k).cast("long")).otherwise(F.lit(0).cast("long"))
            vp, vn = state["vp"], state["vn"]

            def then(d0: Column) -> Column:
                hp = vn.bitwiseOR(d0.bitwiseOR(vp).bitwiseXOR(F.lit(everything).cast("long")))
                hn = d0.bitwiseAND(vp)
                half = F.shiftright(d0, 1)
                last_row = F.call_function("shiftleft", F.lit(1).cast("long"), F.greatest(F.lit(0), F.lit(_TOP - threshold) + m - j))
                diagonal = (d0.bitwiseAND(F.lit(1 << _TOP).cast("long")) == 0).cast("int")
                along = (hp.bitwiseAND(last_row) != 0).cast("int") - (hn.bitwiseAND(last_row) != 0).cast("int")
                return F.struct(
                    hn.bitwiseOR(half.bitwiseOR(hp).bitwiseXOR(F.lit(everything).cast("long"))).alias("vp"),
                    half.bitwiseAND(hp).alias("vn"),
                    (state["score"] + F.when(j <= m - threshold, diagonal).otherwise(along)).alias("score"),
                    (j + 1).alias("j"),
                )

            summed = _let(match, lambda x: x.bitwiseAND(vp).__add__(vp).bitwiseXOR(vp).bitwiseOR(x).bitwiseOR(vn).bitwiseAND(F.lit(everything).cast("long")))
            return F.when(state["score"] > limit, state).otherwise(_let(summed, then))

        start = F.struct(F.lit(((1 << threshold + 1) - 1) << _TOP - threshold).cast("long").alias("vp"), F.lit(0).cast("long").alias("vn"), F.least(m, F.lit(threshold)).alias("score"), F.lit(1).alias("j"))
        return F.aggregate(t, start, step, lambda state: state["score"])

    def without_prefix(x: Column, y: Column) -> Column:
        return _let(prefix(x, y), lambda done: F.struct(F.substring(x, done + 1, F.length(x)).alias("x"), F.substring(y, done + 1, F.length(y)).alias("y")))

    def middle(rest: Column) -> Column:
        """The pair without its common prefix, backwards; without that one's, it has no common suffix."""
        return _let(F.struct(F.reverse(rest["x"]).alias("x"), F.reverse(rest["y"]).alias("y")), lambda back: without_prefix(back["x"], back["y"]))

    def measured(s: Column) -> Column:
        return _let(F.struct(chars(s["x"]).alias("p"), chars(s["y"]).alias("t"), F.length(s["x"]).alias("m"), F.length(s["y"]).alias("n")), distance)

    return (F.abs(F.length(a) - F.length(b)) <= threshold) & (_let(_let(without_prefix(a, b), middle), measured) <= threshold)


def segment_keys(line: Column, threshold: int = THRESHOLD, mutual: bool = False) -> list[tuple[Column, Column, Column, bool]]:
    """(hashed key, start from 0, length, whether it only probes) of each segment key of a line as `_fixed` gives it, where
    a character has a fixed place. A line is indexed under those that do not only probe, and probes with all of them for
    lines as long or shorter.

    mutual: of two lines each is indexed and probes. Then, of two equally long ones two edits apart, an insertion comes first
    in one of them; where neither the first nor the last segments are equal, it lies in the first and the deletion in the
    last, so that line has the other's middle segment one character later, and need not be asked for one earlier."""
    parts = threshold + 1

    def span(length: Column, i: int) -> tuple[Column, Column]:
        """Start and length of segment i of a line: the last ones are a character longer where needed."""
        more = length % parts
        base = F.call_function("div", length, F.lit(parts)).cast("int")
        start = base * i + F.greatest(F.lit(0), more - (parts - i))
        return start, base + F.when(F.lit(parts - i) <= more, 1).otherwise(0)

    own = F.shiftright(F.length(line), 1)
    index, probe = [], []
    for shorter in range(threshold + 1):
        length = own - shorter
        for i in range(parts):
            start, size = span(length, i)
            least = 0 if mutual and not shorter and threshold == 2 else max(-i, shorter - (threshold - i))
            for shift in range(least, min(i, shorter + threshold - i) + 1):
                key = F.xxhash64(length, F.lit(i), F.substring(line, (start + shift) * 2 + 1, size * 2))
                (probe if shorter or shift else index).append((key, start + shift, size, bool(shorter or shift)))
    return index + probe


def _lines(docs: DataFrame, doc_id: str, text: str, min_chars: int, short_repeats: bool = False) -> DataFrame:
    """(doc_id, th, pos, line) of the lines that may go; th tells texts of one doc_id apart."""
    lines = docs.where(F.col(text).isNotNull()).select(F.col(doc_id).alias("doc_id"), F.xxhash64(text).alias("th"), F.posexplode(F.split(text, "\n")).alias("pos", "line"))
    long = F.length("line") >= min_chars
    return lines.where(long | F.col("line").rlike("\\S") if short_repeats else long)


_PLACE = ("doc_id", "th", "pos")


def _place() -> Column:
    return F.struct(F.col("doc_id").isNull().alias("last"), *_PLACE)


def _fixed(rows: DataFrame) -> DataFrame:
    """rows with the column utf16: `line` in two bytes a character. Characters beyond these are all written as one: lines
    within the threshold stay so, and what else meets under a key for it is told apart by the lines themselves."""
    rows = rows.withColumn("utf16", F.encode("line", "UTF-16BE"))
    one = F.encode(F.regexp_replace("line", "[\\x{10000}-\\x{10FFFF}]", "\uFFFD"), "UTF-16BE")
    return rows.withColumn("utf16", F.when(F.length("utf16") == 2 * F.length("line"), F.col("utf16")).otherwise(one))


def _identity() -> list[Column]:
    """128 bits that stand for a line."""
    return [F.xxhash64("line").alias("h1"), F.xxhash64(F.lit("line"), F.col("line")).alias("h2")]


def _spread(rows: DataFrame, carried: list[str], keys: list[tuple[Column, Column, Column, bool]]) -> DataFrame:
    """A row for each segment key: (carried, key, number, probes). The keys are columns first, so that what they share is
    computed once a line; `stack` takes them apart without copying it."""
    wide = rows.select(*carried, *[k[0].alias(f"_k{i}") for i, k in enumerate(keys)])
    cells = [c for i, k in enumerate(keys) for c in (F.col(f"_k{i}"), F.lit(i), F.lit(k[3]))]
    return wide.select(*carried, F.stack(F.lit(len(keys)), *cells).alias("key", "number", "probes"))


def _shared(keyed: DataFrame, name: str) -> DataFrame:
    """The keys under which a line is indexed and another, different one indexed or probing. These are few, what they are
    found in is not, so they are dealt out once more: all tasks look for them, and few files hold them. (Spark leaves out a
    repartition by the very columns that rows are grouped by.)"""
    met = keyed.groupBy("key").agg(F.min("h").alias("a"), F.max("h").alias("b"), F.min("probes").alias("p"))
    return written(met.where("a <> b and not p").select("key").repartition(F.xxhash64("key")), name, few=True)


def _few(keys: DataFrame) -> DataFrame:
    return F.broadcast(keys) if keys.count() <= BROADCAST_KEYS else keys


def near_lines(lines: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """(h1, h2) of the lines that have an earlier, different line within the threshold."""
    coded = _fixed(lines.select(*_PLACE, "line", F.xxhash64("line").alias("h")))
    keys = segment_keys(F.col("utf16"), threshold, mutual=True)
    shared = _shared(_spread(coded, ["h"], keys), "keys")
    # Only hashes meet the shared keys; the few lines that are left are then fetched once.
    held = written(_spread(coded, ["h"], keys).join(_few(shared), "key").distinct(), "held", few=True)
    forget(shared)
    wanted = written(held.groupBy("h").count().select("h"), "wanted", few=True)
    texts = written(coded.join(_few(wanted), "h").groupBy("h", "line").agg(F.min(_place()).alias("first")), "texts", few=True)
    # A key that many lines share is refined: they equal each other there, so at most `threshold` edits are in what
    # remains of them, which is cut into segments again. Lines that probed the key are not indexed there: not mutual.
    sizes = held.groupBy("key").agg(F.count("*").alias("n"))
    sized = written(join_hot(held, sizes, ["key"], F.xxhash64("h", "number")), "sized", few=True)
    many = sized.where(F.col("n") > REFINED).select("key", "probes", "number", "h")
    met = sized.where(F.col("n") <= REFINED).select("key", "probes", "h")
    finer = None
    if not many.isEmpty():
        rest = _fixed(many.join(texts.select("h", "line"), "h"))
        place = F.get(F.array(*[F.struct(start.alias("start"), size.alias("size")) for _, start, size, _ in keys]), F.col("number"))
        rest = rest.select("*", place.alias("at")).select("*", "at.*")
        rest = rest.select("h", F.col("key").alias("above"), F.col("probes").alias("asks"), F.concat(F.expr("substring(utf16, 1, start * 2)"), F.expr("substring(utf16, (start + size) * 2 + 1)")).alias("utf16"))
        finer = _spread(rest, ["h", "above", "asks"], segment_keys(F.col("utf16"), threshold))
        finer = finer.select(F.xxhash64("above", "key").alias("key"), (F.col("probes") | F.col("asks")).alias("probes"), "h")
        again = _shared(finer, "keys")
        finer = written(finer.join(_few(again), "key").distinct(), "finer", few=True)
        met = met.unionByName(finer.select("key", "probes", "h"))
    counted = met.groupBy("key").agg(F.count("*").alias("n"), F.count(F.when(~F.col("probes"), 1)).alias("n_index"))
    parts = counted.select("key", "n", F.ceil(F.col("n_index") / TILE).cast("int").alias("lefts"), F.ceil((F.col("n") - F.col("n_index")) / TILE).cast("int").alias("rights"))
    dealt = join_hot(met, written(parts, "parts", few=True), ["key"], F.xxhash64("h", "probes"))
    # Indexed lines are cut into `lefts` tiles, probing ones into `rights`; each tile of the one side meets each of the
    # other, and the tiles of the indexed side each other once, as groups of (key, left tile, right tile).
    own_left = F.pmod(F.xxhash64("h", F.lit(7)), F.col("lefts")).cast("int")
    among = F.transform(F.sequence(F.lit(0), F.col("lefts") - 1), lambda j: F.struct(F.least(own_left, j).alias("l"), F.greatest(own_left, j).alias("r"), (own_left > j).alias("second"), F.lit(False).alias("probes")))
    lefts = F.transform(F.when(F.col("rights") > 0, F.sequence(F.lit(0), F.col("rights") - 1)).otherwise(F.array().cast("array<int>")), lambda j: F.struct(own_left.alias("l"), j.alias("r"), F.lit(False).alias("second"), F.lit(True).alias("probes")))
    own_right = F.pmod(F.xxhash64("h", F.lit(7)), F.col("rights")).cast("int")
    rights = F.transform(F.sequence(F.lit(0), F.col("lefts") - 1), lambda j: F.struct(j.alias("l"), own_right.alias("r"), F.lit(True).alias("second"), F.lit(True).alias("probes")))
    placed = dealt.select("key", "h", F.explode(F.when(F.col("probes"), rights).otherwise(F.concat(among, lefts))).alias("t")).select("key", "h", "t.*")
    whole = placed.join(texts.withColumnRenamed("h", "th"), F.col("h") == F.col("th")).select("key", "l", "r", "probes", "second", "line", "first")
    tile = F.struct("first", "line", "some", "pieces")
    tiles = _with_pieces(whole, threshold).groupBy("key", "l", "r", "probes").agg(F.collect_list(F.when(~F.col("second"), tile)).alias("a"), F.collect_list(F.when(F.col("second"), tile)).alias("b"))

    def later(own: Column, others: Column) -> Column:
        return F.filter(own, lambda x: F.exists(others, lambda y: (y["first"] < x["first"]) & (x["line"] != y["line"]) & _alike(x, y, threshold) & within_edits(x["line"], y["line"], threshold)))

    # A tile that meets itself has no second side; two tiles are looked at from both.
    two = F.col("probes") | (F.col("l") != F.col("r"))
    seen = F.when(two, F.array(F.struct(F.col("a").alias("own"), F.col("b").alias("others")), F.struct(F.col("b").alias("own"), F.col("a").alias("others")))).otherwise(F.array(F.struct(F.col("a").alias("own"), F.col("a").alias("others"))))
    sides = tiles.select(F.explode(seen).alias("s"))
    found = written(sides.select(F.explode(F.transform(later(F.col("s.own"), F.col("s.others")), lambda x: x["line"])).alias("line")).select(*_identity()).distinct(), "near", few=True)
    for table in (held, wanted, texts, sized, *([finer] if finer else [])):
        forget(table)
    return found


def _with_pieces(rows: DataFrame, threshold: int) -> DataFrame:
    """rows with PIECES pieces of `line`: `some`, every SAMPLED-th, and `pieces`, the others. A line within the threshold
    has all but `threshold` of them. Finding a place in a text takes time by its distance, so pieces are cut out of parts."""
    n = max(PIECES, threshold + 1)
    size = F.col("_size")
    sized = rows.withColumn("_size", F.greatest(F.floor(F.length("line") / n).cast("int"), F.lit(1)))
    parts = sized.select("*", *[F.substring(F.col("line"), size * i + 1, size * PART).alias(f"_part{i}") for i in range(0, n, PART)])
    piece = [F.substring(F.col(f"_part{i - i % PART}"), size * (i % PART) + 1, size) for i in range(n)]
    some, others = (F.array(*[p for i, p in enumerate(piece) if (i % SAMPLED == 0) == first]) for first in (True, False))
    return parts.select(*rows.columns, some.alias("some"), others.alias("pieces"))


def _alike(x: Column, y: Column, threshold: int) -> Column:
    """A cheap test that no pair within the threshold fails, first on a sample of the pieces of y, then on the others."""

    def missing(pieces: Column) -> Column:
        return F.size(F.filter(pieces, lambda p: ~F.contains(x["line"], p)))

    return (missing(y["some"]) <= threshold) & (missing(y["pieces"]) <= threshold)


def dedup_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: int = THRESHOLD, min_chars: int = MIN_CHARS, short_repeats: bool = False) -> DataFrame:
    """docs with the removed lines taken out of `text`, and the columns n_lines and n_removed."""
    near = near_lines(_lines(docs, doc_id, text, min_chars), threshold).withColumn("near", F.lit(True))
    places = _lines(docs, doc_id, text, min_chars, short_repeats).select(*_PLACE, *_identity())
    firsts = places.groupBy("h1", "h2").agg(F.min(_place()).alias("first"), F.count("*").alias("n"))
    repeated = written(firsts.join(_few(near), ["h1", "h2"], "left").where("n > 1 or near").repartition("h2"), "repeated", few=True)
    gone = join_hot(places, repeated, ["h1", "h2"], F.xxhash64(*_PLACE)).where(F.col("near").isNotNull() | (F.col("first") != _place()))
    removed = gone.groupBy(F.col("doc_id").alias("_id"), F.col("th").alias("_th")).agg(F.collect_set("pos").alias("_removed"))
    marked = docs.select(F.struct(*docs.columns).alias("_row"), F.col(doc_id).alias("_own"), F.xxhash64(text).alias("_hash"))
    # The smaller side is hashed, so that no text is sorted.
    joined = marked.join(removed.hint("shuffle_hash"), F.col("_own").eqNullSafe(F.col("_id")) & (F.col("_hash") == F.col("_th")), "left")
    own = F.col("_row")[text]
    joined = joined.select("_row", "_removed", F.split(own, "\n").alias("_split"))
    split = F.col("_split")
    left = F.filter(F.transform(split, lambda line, i: F.when(~F.array_contains("_removed", i), line)), lambda line: line.isNotNull())
    rebuilt = F.when(F.col("_removed").isNull(), own).otherwise(F.array_join(left, "\n"))
    columns = [rebuilt.alias(c) if c == text else F.col("_row")[c].alias(c) for c in docs.columns if c not in ("n_lines", "n_removed")]
    counts = [F.when(own.isNull(), 0).otherwise(F.size(split)).cast("long").alias("n_lines"), F.coalesce(F.size("_removed"), F.lit(0)).cast("long").alias("n_removed")]
    return joined.select(*columns, *counts)


def op10_linededup(spark, sf_dir: str) -> DataFrame:
    kept = dedup_lines(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), short_repeats=True)
    raw = F.coalesce(F.col("text"), F.lit(""))
    return kept.select("doc_id", "n_lines", "n_removed", F.length(raw).cast("long").alias("kept_chars"), F.crc32(raw.cast("binary")).alias("kept_crc32"))
