"""Sample sequences, assembled cell by cell from reference bases and the sample's edits.

A request is turned into a stretch of reference bases plus a range of edit keys.
Each cell of the stretch is spliced on its own from at most one cell of bases and
the sample's edits there; only the finished pieces of one request come together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..grid import DEFAULT_WIDTH, cell_of, cell_start
from ..session import cut_lineage
from .requests import Profile, is_small, profile, sized
from .scan import ordered_scan

TILE = ["chrom", "sample_id", "cell"]
REQUEST = ["region_id", "chrom", "sample_id"]
BAND = 64  # neighbouring cells, as many as a long has bits


def of_asked_samples(coord: DataFrame, requests: DataFrame, few: bool) -> DataFrame:
    """Only the samples a batch asks for; without a shuffle when the batch is small."""
    asked = requests.select("chrom", "sample_id").distinct()
    return coord.join(sized(asked, few), ["chrom", "sample_id"], "left_semi")


def edits_of(coord: DataFrame) -> DataFrame:
    """Path variants as edits.  A same-length replacement of several bases becomes one
    edit per base, so that a window may begin or end inside it."""
    per_base = F.transform(
        F.sequence(F.lit(0), F.length("alt") - 1),
        lambda i: F.struct(
            (F.col("lo") + i).alias("lo"), (F.col("lo") + i).alias("hi"),
            F.substring(F.col("alt"), i + 1, F.lit(1)).alias("alt"),
            (F.col("edit_key") + 2 * i).alias("key"),
        ),
    )
    whole = F.array(F.struct("lo", "hi", "alt", F.col("edit_key").alias("key")))
    many = (F.col("kind") == "SUB") & (F.length("alt") > 1)
    return coord.select(
        "chrom", "sample_id", "shift", F.explode(F.when(many, per_base).otherwise(whole)).alias("e")
    ).select("chrom", "sample_id", "shift", "e.lo", "e.hi", "e.alt", "e.key")


def _spread(coord: DataFrame, width: int) -> DataFrame:
    """A row per edit and cell that it reaches."""
    return edits_of(coord).withColumn(
        "cell", F.explode(F.sequence(cell_of("lo", width),
                                     cell_of(F.greatest("lo", "hi"), width))))


def edit_tiles(coord: DataFrame, wanted: DataFrame | None = None,
               width: int = DEFAULT_WIDTH) -> DataFrame:
    """A sample's edits per cell, in path order.  An edit reaching over several cells is
    listed in each; its ALT bases belong to the first.  ``wanted`` cells cut the edits
    before they are gathered."""
    spread = _spread(coord, width)
    entry = F.struct(
        "key", "lo", "hi",
        F.when(F.col("cell") == cell_of("lo", width), F.col("alt")).otherwise("").alias("alt"))
    if wanted is not None:
        spread = spread.join(wanted, TILE, "left_semi")
    return spread.groupBy(*TILE).agg(F.sort_array(F.collect_list(entry)).alias("edits"))


def _splice(bases: Column, start: Column, a: Column, b: Column, edits: Column,
            key_lo: Column) -> Column:
    """Bases ``a..b`` of a cell with its edits applied; an edit with a key below
    ``key_lo`` began before the window and only hides bases."""
    def piece(lo: Column, hi: Column) -> Column:
        n = F.greatest(hi - lo + 1, F.lit(0))
        return F.substring(bases, (lo - start + 1).cast("int"), n.cast("int"))

    shape = "struct<upto: bigint, text: array<string>>"
    begin = F.struct((a - 1).alias("upto"), F.array().cast("array<string>").alias("text")).cast(shape)

    def step(acc: Column, e: Column) -> Column:
        alt = F.when(e["key"] >= key_lo, e["alt"]).otherwise("")
        added = F.concat(piece(acc["upto"] + 1, F.least(e["lo"] - 1, b)), alt)
        return F.struct(
            F.greatest(acc["upto"], e["hi"]).alias("upto"),
            F.concat(acc["text"], F.array(added)).alias("text"),
        ).cast(shape)

    return F.aggregate(
        edits, begin, step,
        lambda acc: F.concat(F.array_join(acc["text"], ""), piece(acc["upto"] + 1, b)))


def _near(prof: Profile, coord: DataFrame, ref_chunk: DataFrame,
          width: int) -> tuple[DataFrame, DataFrame]:
    """Edits and reference cells within the hull of the requests."""
    if not prof.rows:
        return coord, ref_chunk
    return (
        coord.where((F.col("hi") >= prof.low - 1) & (F.col("lo") <= prof.high + 1)),
        ref_chunk.where((F.col("start") > prof.low - width) & (F.col("start") <= prof.high + 1)))


def _with_last(spans: DataFrame) -> DataFrame:
    """Spans that hold something, with the last position ``_last`` they or their edits touch."""
    last = F.greatest("ref_hi", F.call_function("div", F.col("key_hi"), F.lit(2)))
    return spans.withColumn("_last", last).where(F.col("ref_lo") <= F.col("_last"))


def _assemble(spans: DataFrame, coord: DataFrame, ref_chunk: DataFrame, width: int,
              prof: Profile, keep: tuple[str, ...] = ()) -> DataFrame:
    """Spliced pieces ``(region_id, chrom, sample_id, cell, text)`` of spans
    ``(region_id, chrom, sample_id, ref_lo, ref_hi, key_lo, key_hi)``; columns named in
    ``keep`` come along.  ``prof`` counts the spans' cells and bounds their positions.
    """
    cells = _with_last(spans).withColumn(
        "cell", F.explode(F.sequence(cell_of("ref_lo", width), cell_of("_last", width)))
    ).drop("_last")
    source, chunk = _near(prof, coord, ref_chunk, width)
    tiles = edit_tiles(source, sized(cells.select(*TILE).distinct(), prof.broadcastable), width)
    return _spliced(cells, tiles, chunk, width, keep)


def _spliced(cells: DataFrame, tiles: DataFrame, chunk: DataFrame, width: int,
             keep: tuple[str, ...] = ()) -> DataFrame:
    """The pieces of cells of spans, each a row of its own."""
    first = cell_start(F.col("cell"), width)
    a = F.greatest(first, F.col("ref_lo"))
    b = F.least(first + width - 1, F.col("ref_hi"))
    edits = F.coalesce("edits", F.expr(
        "cast(array() as array<struct<key: bigint, lo: bigint, hi: bigint, alt: string>>)"))
    wanted = F.filter(edits, lambda e: (e["key"] <= F.col("key_hi")) & (
        (e["key"] >= F.col("key_lo")) | (e["hi"] >= F.col("ref_lo"))))
    text = _splice(F.coalesce("bases", F.lit("")), first, a, b, wanted, F.col("key_lo"))
    return (
        cells.join(tiles, TILE, "left")
        .join(chunk.select("chrom", "cell", "bases"), ["chrom", "cell"], "left")
        .select(*REQUEST, *keep, "cell", text.alias("text"), (F.col("cell") > cell_of(
            F.greatest("ref_lo", "ref_hi"), width)).alias("_beyond"))
        # The cell after the last base is there for an insertion only.
        .where(~F.col("_beyond") | (F.col("text") != "")).drop("_beyond")
    )


def _bands(spans: DataFrame, coord: DataFrame, width: int) -> DataFrame:
    """A row per span and band of ``BAND`` cells; the bits of ``edited`` tell the cells in
    which the sample has an edit."""
    key = ["chrom", "band", "sample_id"]
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), _in_band("cell").cast("int"))
    edited = _spread(coord, width).withColumn("band", _band_of("cell")).groupBy(*key).agg(F.bit_or(bit).alias("edited"))
    dealt = spans.repartition(spans.sparkSession.sparkContext.defaultParallelism, "region_id").withColumn(
        "band", F.explode(F.sequence(_band_of(cell_of("ref_lo", width)), _band_of(cell_of("_last", width)))))
    return dealt.join(edited.hint("merge"), key, "left").withColumn("edited", F.coalesce("edited", F.lit(0).cast("long")))


def _plain(bands: DataFrame, chunk: DataFrame, width: int) -> DataFrame:
    """The cells that spans cover whole and without an edit: the bases as they are."""
    small = is_small(chunk.select("cell", "bases"))
    # A cell holds ``width`` bases at most; one that is missing reads as none.
    text = F.struct(_in_band("cell"), F.coalesce(F.substring("bases", 1, width), F.lit("")))
    known = chunk.where(F.col("cell").isNotNull()).groupBy("chrom", _band_of("cell").alias("band")).agg(
        F.map_from_entries(F.collect_list(text)).alias("known"))
    texts = known.select("chrom", "band", F.transform(
        F.sequence(F.lit(0).cast("long"), F.lit(BAND - 1).cast("long")),
        lambda i: F.coalesce(F.try_element_at("known", i), F.lit(""))).alias("texts"))
    none = F.array_repeat(F.lit(""), BAND)
    if small:
        # Bands are small and what comes of them is not, so that their size tells nothing.  The
        # samples of a band follow each other, which keeps the texts of a file few.
        # (In the order of the join's keys the planner would take its partitions for these.)
        n = int(bands.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        bands = bands.repartition(n, "sample_id", "band", "chrom").sortWithinPartitions("chrom", "band")
    every = bands.join(sized(texts, small), ["chrom", "band"], "left").select(
        *REQUEST, "band", "edited", "ref_lo", "ref_hi", F.posexplode(F.coalesce("texts", none)).alias("at", "text"))
    cell = F.col("band") * BAND + F.col("at")
    return every.where((F.getbit("edited", F.col("at")) == 0) & _covered(cell, width)).select(
        *REQUEST, cell.alias("cell"), "text")


def _band_of(cell: Column | str) -> Column:
    return F.shiftright(F.col(cell) if isinstance(cell, str) else cell, BAND.bit_length() - 1)


def _in_band(cell: Column | str) -> Column:
    return (F.col(cell) if isinstance(cell, str) else cell).bitwiseAND(F.lit(BAND - 1).cast("long"))


def _covered(cell: Column, width: int) -> Column:
    """Whether a span takes all bases of a cell."""
    first = cell_start(cell, width)
    return (first >= F.col("ref_lo")) & (first + width - 1 <= F.col("ref_hi"))


def _join_pieces(pieces: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    gathered = pieces.groupBy(*REQUEST, *keep).agg(
        F.sort_array(F.collect_list(F.struct("cell", "text"))).alias("p"))
    return gathered.select(
        *REQUEST, *keep,
        F.array_join(F.transform("p", lambda e: e["text"]), "").alias("sequence"))


def _ref_spans(requests: DataFrame, contig: DataFrame) -> DataFrame:
    """Reference windows ``[x, y)``.  A window open to the contig's end also takes the
    insertion after its last base."""
    length = F.col("length")
    open_end = F.col("y") > length
    return requests.join(contig, "chrom").where(F.col("x") < F.col("y")).select(
        "region_id", "chrom", "sample_id", F.col("x").alias("ref_lo"),
        F.least(F.col("y") - 1, length).alias("ref_hi"), (F.col("x") * 2).alias("key_lo"),
        F.when(open_end, (length + 1) * 2).otherwise(F.col("y") * 2 - 1).alias("key_hi"))


def sample_sequence_pieces(requests: DataFrame, coord: DataFrame, ref_chunk: DataFrame,
                           contig: DataFrame, width: int = DEFAULT_WIDTH) -> DataFrame:
    """The sample's bases for reference window ``[x, y)``, one row per cell; the rows in
    cell order spell the sequence.  For windows as long as a contig."""
    prof = profile(requests, "x", "y", width)
    mine = of_asked_samples(coord, requests, prof.few)
    source, chunk = _near(prof, mine, ref_chunk, width)
    bands = _bands(_with_last(_ref_spans(requests, contig)), source, width)
    # Whole cells without an edit are most of the rows as a rule.  They are made where the
    # bands lie; only the others meet their edits and are spliced.
    low, high = F.col("band") * BAND, F.col("band") * BAND + BAND - 1
    rest = F.filter(
        F.sequence(F.greatest(low, cell_of("ref_lo", width)), F.least(high, cell_of("_last", width))),
        lambda c: (F.getbit("edited", _in_band(c).cast("int")) != 0) | ~_covered(c, width))
    whole = (F.col("edited") == 0) & (cell_start(low, width) >= F.col("ref_lo")) & (
        cell_start(high + 1, width) <= F.col("ref_hi") + 1)
    cells = bands.where(~whole).withColumn("cell", F.explode(rest)).drop("band", "edited", "_last")
    return _plain(bands, chunk, width).unionByName(_spliced(cells, edit_tiles(source, None, width), chunk, width))


def sample_sequence_ref(requests: DataFrame, coord: DataFrame, ref_chunk: DataFrame,
                        contig: DataFrame, width: int = DEFAULT_WIDTH) -> DataFrame:
    """The sample's bases for reference window ``[x, y)``, one string per request."""
    return _join_pieces(sample_sequence_pieces(requests, coord, ref_chunk, contig, width))


def _edit_at(points: DataFrame, coord: DataFrame, width: int) -> DataFrame:
    """Add ``e``, the last path edit that begins at or before each sample position ``at``.

    Of several edits beginning at one position (deletions take none) it is the last in
    path order, the one the position falls on.
    """
    by = ["chrom", "sample_id"]
    begins = F.col("lo") + F.col("shift")
    edits = edits_of(coord).select(
        *by, begins.alias("at"), "key", F.lit(0).alias("asks"),
        F.struct(begins.alias("begins"), "key", "lo", "hi", F.length("alt").alias("size")).alias("e"))
    asked = points.select(*by, "at").distinct().select(
        "*", F.lit(0).cast("long").alias("key"), F.lit(1).alias("asks"),
        F.lit(None).cast(edits.schema["e"].dataType).alias("e"))
    axis = edits.unionByName(asked).withColumn("_cell", cell_of("at", width))
    found = ordered_scan(axis, by, "_cell", ["at", "asks", "key"], last=("max_before", F.col("e")))
    answers = found.where(F.col("asks") == 1).select(*by, "at", F.col("last").alias("e"))
    return points.join(answers, [*by, "at"])


def _sample_spans(requests: DataFrame, coord: DataFrame, contig: DataFrame,
                  width: int) -> DataFrame:
    """Sample windows ``[x, y)`` as reference spans, with how much to cut off the front."""
    asked = requests.select("region_id", "chrom", "sample_id", "x", "y").where(
        F.col("x") < F.col("y"))
    # Both ends of every window are looked up together and brought back to one row.
    ends = asked.select("*", F.explode(F.array("x", F.col("y") - 1)).alias("at"))
    found = _edit_at(ends, coord, width)
    e, at = F.col("e"), F.col("at")
    past = at - e["begins"] - e["size"]
    inside = F.coalesce(past < 0, F.lit(False))
    ref = F.when(e.isNull(), at).when(inside, e["lo"]).otherwise(e["hi"] + 1 + past)
    key = F.coalesce(e["key"], F.lit(0).cast("long"))
    left = F.struct(
        ref.alias("ref_lo"), F.when(inside, key).otherwise(key + 1).alias("key_lo"),
        F.when(inside, at - e["begins"]).otherwise(F.lit(0)).alias("skip"))
    right = F.struct(F.when(inside, ref - 1).otherwise(ref).alias("ref_hi"), key.alias("key_hi"))
    return (
        found.groupBy("region_id", "chrom", "sample_id", "x", "y").agg(
            F.max(F.when(F.col("at") == F.col("x"), left)).alias("l"),
            F.max(F.when(F.col("at") == F.col("y") - 1, right)).alias("r"))
        .join(contig, "chrom")
        .select("region_id", "chrom", "sample_id", "l.ref_lo",
                F.least("r.ref_hi", "length").alias("ref_hi"), "l.key_lo", "r.key_hi", "l.skip",
                (F.col("y") - F.col("x")).alias("take"))
    )


def sample_sequence_sample(requests: DataFrame, coord: DataFrame, ref_chunk: DataFrame,
                           contig: DataFrame, width: int = DEFAULT_WIDTH) -> DataFrame:
    """The sample's bases for window ``[x, y)`` of its own coordinates."""
    few = profile(requests, "x", "y", width).few
    mine = of_asked_samples(coord, requests, few)
    # One short row per request, written out: it is read several times below, and only
    # now are the reference cells to be fetched known.
    spans = cut_lineage(_sample_spans(requests, mine, contig, width))
    last = F.greatest("ref_hi", F.call_function("div", F.col("key_hi"), F.lit(2)))
    prof = profile(spans.withColumn("_end", last + 1), "ref_lo", "_end", width)
    cut = ("skip", "take")
    whole = _join_pieces(_assemble(spans, mine, ref_chunk, width, prof, cut), cut)
    return whole.select(
        *REQUEST,
        F.substring(F.col("sequence"), (F.col("skip") + 1).cast("int"),
                    F.col("take").cast("int")).alias("sequence"))
