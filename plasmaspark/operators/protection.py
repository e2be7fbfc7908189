"""Windowed protection scores around anchors, without dense positions."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plasmaspark.operators.intervals import as_right, overlap

#: Protection half-window, lengths that count fully, and partly (half).
KINDS = {"nuc": (60, (160, 175), (120, 180)), "tf": (8, (35, 80), (35, 80))}


def length_weight(length: Column, kind: str) -> Column:
    _, full, part = KINDS[kind]
    return F.when(length.between(*full), 1.0).when(length.between(*part), 0.5).otherwise(0.0)


def ranges(fragments: DataFrame, anchors: DataFrame, kind: str = "nuc", weight: Column | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """(keep, region_idx, plus, size, low, high, w, what): signed ranges in each anchor's own positions (0 is its start). what: cov, span, end."""
    p = KINDS[kind][0]
    weighted = fragments.withColumn("w", length_weight(F.col("length"), kind) * (weight if weight is not None else F.lit(1.0))).where("w > 0").drop("plus")
    hits = overlap(weighted, as_right(anchors).withColumn("r0", F.col("r_start")).withColumn("size", F.col("r_end") - F.col("r_start")).hint("merge"), slack=60)  # anchors may be many: a broadcast goes by the size of their files
    s, e = F.col("start") + 1 - F.col("r0"), F.col("end") - F.col("r0")
    part = lambda what, low, high: F.struct(F.lit(what).alias("what"), low.alias("low"), high.alias("high"))
    each = F.explode(F.array(part("cov", s, e), part("span", s + p, e - p + 1), part("end", s - p, s + p), part("end", e - p + 1, e + p + 1)))
    flat = hits.select(*keep, "region_idx", "plus", "size", "w", each.alias("x")).select(*keep, "region_idx", "plus", "size", "w", "x.what", F.greatest(F.lit(0), "x.low").alias("low"), F.least("size", "x.high").alias("high"))
    return flat.where("low < high")


def binned(parts: DataFrame, width: int = 10) -> DataFrame:
    """(region_idx, bin, cov, span, ends, wps): means per bin of width positions, from the overlap of each range with each bin."""
    each = parts.withColumn("bin", F.explode(F.expr(f"sequence(low div {width}, (high - 1) div {width})")))
    # divided after the sum: with weights of halves the sums are exact in any order
    covered = F.col("w") * (F.least("high", (F.col("bin") + 1) * width) - F.greatest("low", F.col("bin") * width))
    sums = each.groupBy("region_idx", "bin").agg(*[(F.sum(F.when(F.col("what") == w, covered).otherwise(0.0)) / width).alias(n) for w, n in (("cov", "cov"), ("span", "span"), ("end", "ends"))])
    return sums.withColumn("wps", F.col("span") - F.col("ends")).withColumn("prot_frac", F.when(F.col("span") + F.col("ends") > 0, F.col("span") / (F.col("span") + F.col("ends"))).otherwise(0.0))


def positions(parts: DataFrame, what: str = "span") -> DataFrame:
    """(region_idx, pos, value): the running sum over each region's changes; value holds from pos to the next row's."""
    deltas = parts.where(F.col("what") == what).select("region_idx", F.explode(F.array(F.struct(F.col("low").alias("pos"), F.col("w").alias("d")), F.struct(F.col("high").alias("pos"), (-F.col("w")).alias("d")))).alias("x"))
    steps = deltas.groupBy("region_idx", "x.pos").agg(F.sum("x.d").alias("d"))
    running = Window.partitionBy("region_idx").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    return steps.select("region_idx", "pos", F.sum("d").over(running).alias("value"))


#: Interior weights of the smoothing filter.
SMOOTH = {11: ([-36, 9, 44, 69, 84, 89, 84, 69, 44, 9, -36], 429), 7: ([-2, 3, 6, 7, 6, 3, -2], 21)}


def smoothed(values: DataFrame, width: int, key: str, order: str, value: str) -> DataFrame:
    """Cubic smoothing of each key's series where the whole window exists; elsewhere the value itself."""
    weights, total = SMOOTH[width]
    w, half = Window.partitionBy(key).orderBy(order), width // 2
    near = [F.lag(value, half - i).over(w) if i < half else F.lead(value, i - half).over(w) if i > half else F.col(value) for i in range(width)]
    terms = sum((n * c for n, c in zip(near, weights, strict=True)), F.lit(0.0)) / total
    return values.withColumn("smooth", F.coalesce(terms, F.col(value)))


def reliable(points: DataFrame, baits: DataFrame, trim: int = 50) -> DataFrame:
    """points with reliable: inside a bait by at least min(trim, a quarter of the bait) on both sides. points: chrom, pos and a key."""
    from plasmaspark.operators.intervals import contains_point

    hits = contains_point(points, as_right(baits).withColumn("b0", F.col("r_start")).withColumn("b1", F.col("r_end")), F.col("pos"))
    edge = F.least(F.lit(trim), F.floor((F.col("b1") - F.col("b0")) / 4))
    inside = (F.col("pos") - F.col("b0") >= edge) & (F.col("b1") - F.col("pos") >= edge)
    flag = hits.groupBy("chrom", "pos").agg(F.max(inside).alias("reliable"))
    return points.join(flag, ["chrom", "pos"], "left").withColumn("reliable", F.coalesce("reliable", F.lit(False)))


#: Positions of a tile; intervals are cut at its borders, so that what lies in one is found in one.
TILE = 1024


def _tiled(rows: DataFrame) -> DataFrame:
    """rows (chrom, low, high) cut at the borders of tiles, with tile."""
    each = rows.withColumn("tile", F.explode(F.expr(f"sequence(cast(floor(low / {TILE}) as bigint), cast(floor((high - 1) / {TILE}) as bigint))")))
    return each.withColumn("low", F.greatest("low", F.col("tile") * TILE)).withColumn("high", F.least("high", (F.col("tile") + 1) * TILE))


def _joined(rows: DataFrame, keys: list[str]) -> DataFrame:
    """rows with run: the number, within keys, of the stretch of touching intervals [low, high) that a row belongs to."""
    at = Window.partitionBy(*keys).orderBy("low")
    begun = F.coalesce(F.col("low") > F.max("high").over(at.rowsBetween(Window.unboundedPreceding, -1)), F.lit(True))
    return rows.withColumn("begun", begun.cast("int")).withColumn("run", F.sum("begun").over(at.rowsBetween(Window.unboundedPreceding, 0))).groupBy(*keys, "run").agg(F.min("low").alias("low"), F.max("high").alias("high")).drop("run")


def reliable_spans(baits: DataFrame, trim: int = 50) -> DataFrame:
    """(chrom, tile, low, high): the reliable positions (see reliable) as intervals that don't touch within a tile, however many baits overlap."""
    edge = F.least(F.lit(trim), F.floor((F.col("r_end") - F.col("r_start")) / 4))
    inside = as_right(baits.select("chrom", "start", "end")).select(F.col("r_chrom").alias("chrom"), (F.col("r_start") + edge).cast("bigint").alias("low"), F.least(F.col("r_end") - edge + 1, "r_end").cast("bigint").alias("high"))
    return _joined(_tiled(inside.where("low < high")).groupBy("chrom", "tile", "low").agg(F.max("high").alias("high")), ["chrom", "tile"])


def bin_masks(anchors: DataFrame, n: int, baits: DataFrame, width: int = 10, trim: int = 50) -> DataFrame:
    """(region_idx, masks): ranges (first, last) of those of each anchor's n bins whose positions are all reliable; anchors without any are absent."""
    seen = _tiled(anchors.select("region_idx", "chrom", F.col("start").cast("bigint").alias("r0"), F.col("start").cast("bigint").alias("low"), (F.col("start") + n * width).cast("bigint").alias("high")))
    spans = reliable_spans(baits, trim).withColumnsRenamed({"low": "b0", "high": "b1"})
    hits = seen.join(spans.hint("merge"), ["chrom", "tile"]).where("b0 < high AND b1 > low").select("region_idx", (F.greatest("low", "b0") - F.col("r0")).alias("low"), (F.least("high", "b1") - F.col("r0")).alias("high"))
    # by region first: what follows needs no other shuffle
    whole = _joined(hits.repartition("region_idx"), ["region_idx"]).select("region_idx", F.expr(f"(low + {width - 1}) div {width}").alias("first"), F.expr(f"high div {width} - 1").alias("last")).where("first <= last")
    return whole.groupBy("region_idx").agg(F.collect_list(F.struct("first", "last")).alias("masks"))  # n / 2 at most


def oriented(bins: DataFrame, anchors: DataFrame, n: int = 200, baits: DataFrame | None = None, width: int = 10) -> DataFrame:
    """n bins of every anchor that has any: zeros where nothing is, turned round on minus, the score smoothed after that; reliable tells bins inside the baits (all, without).

    Bins are dealt by anchor once; each fills the gap before it, the last the rest too, and reliable bins come as ranges per anchor. Nothing is broadcast.
    """
    values = ("cov", "span", "ends", "wps", "prot_frac")
    mine = Window.partitionBy("region_idx").orderBy("bin")
    dealt = bins.select("region_idx", F.col("bin").cast("bigint").alias("bin"), *values).repartition("region_idx")
    gaps = dealt.withColumn("first", F.coalesce(F.lag("bin").over(mine) + 1, F.lit(0).cast("bigint"))).withColumn("last", F.when(F.lead("bin").over(mine).isNull(), F.greatest("bin", F.lit(n - 1).cast("bigint"))).otherwise(F.col("bin")))
    placed = gaps.join(anchors.select("region_idx", "plus").hint("merge"), "region_idx")
    if baits is not None:
        placed = placed.join(bin_masks(anchors, n, baits, width).hint("merge"), "region_idx", "left")
    filled = placed.withColumn("at", F.explode(F.sequence("first", "last"))).where(F.col("at") < n)
    reliable = F.lit(True) if baits is None else F.coalesce(F.exists("masks", lambda m: F.col("at").between(m["first"], m["last"])), F.lit(False))
    bin = F.when(F.col("plus"), F.col("at")).otherwise(n - 1 - F.col("at")).alias("bin")
    turned = filled.select("region_idx", bin, "plus", *[F.when(F.col("at") == F.col("bin"), F.col(v)).otherwise(0.0).alias(v) for v in values], reliable.alias("reliable"))
    return smoothed(turned, 11, "region_idx", "bin", "wps")


#: Columns of a position's sums: what and kind.
SUMS = {f"{what}_{name}": (what, kind) for name, kind in (("long", "nuc"), ("short", "tf")) for what in ("cov", "span", "end")}


def _runs(fragments: DataFrame, pieces: DataFrame, weight: Column | None, baits: DataFrame | None) -> DataFrame:
    """(chrom, tile, low, high, first, touched, mask, SUMS): runs of positions with the same sums, which cover every tile of pieces (chrom, tile).

    Sums hang on the anchor in one thing: a fragment that ends half a window before an anchor isn't joined to it, though its end reaches
    the anchor's first position. Such a position has two runs, and first tells which is for anchors that start there; it is null
    elsewhere. touched counts the ranges that lie there.
    """
    far = KINDS["nuc"][0]
    weights = [F.greatest(F.lit(0.0), length_weight(F.col("length"), k) * (weight if weight is not None else F.lit(1.0))).alias(k) for k in KINDS]
    # equal fragments together, so that a tile holds a bounded number of them at any depth
    same = fragments.select("chrom", F.col("start").cast("bigint").alias("start"), F.col("end").cast("bigint").alias("end"), *weights).where("nuc > 0 OR tf > 0").groupBy("chrom", "start", "end").agg(F.sum("nuc").alias("nuc"), F.sum("tf").alias("tf"))
    tiles = pieces.select("chrom", "tile").distinct()
    row = lambda what, start, end, nuc=F.lit(0.0), tf=F.lit(0.0): ("chrom", "tile", F.lit(what).alias("is"), start.alias("start"), end.alias("end"), nuc.alias("nuc"), tf.alias("tf"))
    rows = _tiled(same.withColumn("low", F.col("start") + 1 - far).withColumn("high", F.col("end") + 1 + far)).select(*row("fragment", F.col("start"), F.col("end"), F.col("nuc"), F.col("tf")))
    rows = rows.unionAll(tiles.select(*row("tile", F.col("tile") * TILE, (F.col("tile") + 1) * TILE)))
    if baits is not None:
        rows = rows.unionAll(reliable_spans(baits).select(*row("bait", F.col("low"), F.col("high"))))
    # by tile while narrow; the sums then need no other shuffle
    dealt = rows.repartition("chrom", "tile").join(tiles.hint("merge"), ["chrom", "tile"], "left_semi")
    s, e = F.col("start") + 1, F.col("end")
    part = lambda what, low, high, w: F.struct(F.lit(what).alias("what"), low.alias("low"), high.alias("high"), w.alias("w"))
    ranges = [part("bait", F.col("start"), e, F.when(F.col("is") == "bait", 1.0)), part("tile", F.col("start"), e, F.when(F.col("is") == "tile", 0.0))]
    for name, kind in (("long", "nuc"), ("short", "tf")):
        p, w = KINDS[kind][0], F.when((F.col("is") == "fragment") & (F.col(kind) > 0), F.col(kind))
        ranges += [part(f"cov_{name}", s, e, w), part(f"span_{name}", s + p, e - p + 1, w), part(f"end_{name}", s - p, s + p, w), part(f"end_{name}", e - p + 1, e + p + 1, w)]
        ranges += [part("late", e + p, e + p + 1, w)] if p == far else []
    begin, end = F.col("tile") * TILE, (F.col("tile") + 1) * TILE
    cut = dealt.select("chrom", "tile", F.explode(F.array(*ranges)).alias("x")).where("x.w IS NOT NULL").select("chrom", "tile", "x.what", F.greatest("x.low", begin).alias("low"), F.least("x.high", end).alias("high"), "x.w").where("low < high")
    change = lambda at, sign: F.struct(F.col(at).alias("at"), (F.col("w") * sign).alias("d"), F.lit(sign).alias("n"))
    changes = cut.select("chrom", "tile", "what", F.explode(F.array(change("low", 1), change("high", -1))).alias("x")).where(F.col("x.at") < end)
    what = F.col("what")
    sums = [F.sum(F.when(what == n, F.col("x.d")).otherwise(0.0)).alias(n) for n in (*SUMS, "late", "bait")]
    counts = [F.sum(F.when(what.isin(*SUMS), F.col("x.n")).otherwise(0)).alias("touched"), F.sum(F.when(what == "late", F.col("x.n")).otherwise(0)).alias("lates")]
    steps = changes.groupBy("chrom", "tile", F.col("x.at").alias("low")).agg(*sums, *counts)
    by = Window.partitionBy("chrom", "tile").orderBy("low")
    so_far = by.rowsBetween(Window.unboundedPreceding, 0)
    state = steps.select("chrom", "tile", "low", F.coalesce(F.lead("low").over(by), end).alias("high"), *[F.sum(n).over(so_far).alias(n) for n in (*SUMS, "late", "bait", "touched", "lates")])
    one = lambda first, late, lates: F.struct(first.cast("boolean").alias("first"), (F.col("end_long") - late).alias("end_long"), (F.col("touched") - lates).alias("touched"))
    whole, without = (lambda first: one(F.lit(first), F.lit(0.0), F.lit(0))), one(F.lit(True), F.col("late"), F.col("lates"))
    each = state.withColumn("x", F.explode(F.when(F.col("lates") > 0, F.array(whole(False), without)).otherwise(F.array(whole(None)))))
    return each.select("chrom", "tile", "low", "high", "x.first", "x.touched", (F.col("bait") > 0.5).cast("int").alias("mask"), *[(F.round(F.col("x.end_long") if n == "end_long" else F.col(n), 9) + 0.0).alias(n) for n in SUMS])


def position_table(fragments: DataFrame, anchors: DataFrame, weight: Column | None = None, baits: DataFrame | None = None, shown=lambda name, value: value) -> DataFrame:
    """Both kinds' coverage and scores at every position of the anchors (region_idx, region_id, chrom, start, end, plus) that have fragments.

    row counts an anchor's positions from 0, from its end on minus; the _norm
    columns are per million fragments; capture_mask is 1 without baits; shown
    (name, value) gives a score's form. Scores are made once for each run of
    positions that have the same, however many anchors lie there; anchors are
    joined to runs by tile, and their rows aren't shuffled.
    """
    at = as_right(anchors.select("region_idx", "region_id", "plus", "chrom", "start", "end")).withColumnRenamed("r_chrom", "chrom").withColumns({c: F.col(c).cast("bigint") for c in ("r_start", "r_end")})
    pieces = _tiled(at.withColumn("low", F.col("r_start")).withColumn("high", F.col("r_end"))).withColumnsRenamed({"low": "p0", "high": "p1"})
    runs = _runs(fragments, pieces, weight, baits)
    runs = runs.withColumnsRenamed({"chrom": "b_chrom", "tile": "b_tile"})
    c = F.col
    meet = (c("chrom") == c("b_chrom")) & (c("tile") == c("b_tile")) & (c("low") < c("p1")) & (c("high") > c("p0")) & (c("first").isNull() | (c("first") == (c("r_start") == c("low"))))
    found = pieces.join(runs.where("touched > 0").hint("merge"), meet, "left_semi").select("region_idx").distinct()
    million = F.broadcast(fragments.agg((F.count("*") / 1e6).alias("million")))  # one row
    for k in ("long", "short"):
        total = F.col(f"span_{k}") + F.col(f"end_{k}")
        runs = runs.withColumn(f"wps_{k}", F.col(f"span_{k}") - F.col(f"end_{k}")).withColumn(f"frac_{k}", F.when(total > 1e-9, F.col(f"span_{k}") / total).otherwise(0.0))
    ratio = F.when(F.abs("wps_short") > 1e-9, F.col("wps_long") / F.abs("wps_short")).otherwise(F.col("wps_long"))
    scores = {c: F.col(c) for c in ("cov_long", "cov_short", "wps_long", "wps_short", "wps_ratio")} | {f"{c}_norm": F.col(c) / F.col("million") for c in ("wps_long", "wps_short", "wps_ratio")} | {"prot_frac_nuc": F.col("frac_long"), "prot_frac_tf": F.col("frac_short")}
    scored = runs.withColumn("wps_ratio", ratio).join(million).select("b_chrom", "b_tile", "low", "high", "first", (F.col("mask") if baits is not None else F.lit(1)).alias("capture_mask"), *[shown(n, c).alias(n) for n, c in scores.items()])
    kept = pieces.join(found.hint("merge"), "region_idx", "left_semi")
    rows = kept.join(scored.hint("merge"), meet).withColumn("pos", F.explode(F.sequence(F.greatest("low", "p0"), F.least("high", "p1") - 1)))
    kind = F.when(F.col("region_id").startswith("TSS|"), "TSS").when(F.col("region_id").startswith("CTCF|"), "CTCF").otherwise("OTHER")
    return rows.select(
        "region_idx", F.when(F.col("plus"), F.col("pos") - F.col("r_start")).otherwise(F.col("r_end") - 1 - F.col("pos")).alias("row"),
        "region_id", "chrom", "pos", F.when(F.col("plus"), "+").otherwise("-").alias("strand"), kind.alias("region_type"), "capture_mask", *scores,
    )


def periodicity(profile: np.ndarray, step: int = 10, band: tuple[int, int] = (140, 200)) -> dict[str, float]:
    """Repeat length and score of a profile: detrended, normalised, Hann window, strongest frequency with its period in the band."""
    n = len(profile)
    x = np.arange(n)
    flat = profile - np.polyval(np.polyfit(x, profile, 1), x) if n > 1 else profile * 0
    std = flat.std()
    if std < 1e-9:
        return {"nrl": 0.0, "snr": 0.0, "score": 0.0, "deviation": 190.0, "adjusted": 0.0}
    power = np.abs(np.fft.rfft((flat - flat.mean()) / std * np.hanning(n)))
    periods = np.array([np.inf, *(n * step / k for k in range(1, len(power)))])
    inside = np.flatnonzero((periods >= band[0]) & (periods <= band[1]))
    if not len(inside):
        return {"nrl": 0.0, "snr": 0.0, "score": 0.0, "deviation": 190.0, "adjusted": 0.0}
    peak = inside[np.argmax(power[inside])]
    snr = float(power[peak] / power[inside].mean())
    nrl = float(periods[peak])
    score = min(snr / 3, 1.0)
    return {"nrl": nrl, "snr": snr, "score": score, "deviation": abs(nrl - 190), "adjusted": score * max(0.0, 1 - abs(nrl - 190) / 20)}


def stacking(fragments: DataFrame, elements: DataFrame, size: int = 300) -> DataFrame:
    """(grp, pos, nuc, tf): summed weights of fragments whose protected part covers each of the first `size` positions of their elements, mirrored on minus, over all, by family and by chromosome.

    Both kinds stand where the nucleosome's half-window leaves a fragment; elements' ends are part of them.
    """
    hits = _on_elements(fragments, elements)
    low, high = F.greatest(F.lit(0), F.col("start") + 61 - F.col("e0")), F.least(F.lit(size - 1), F.col("end") - 60 - F.col("e0"))
    spans = hits.select("family", "c", "plus", "nuc", "tf", low.alias("low"), high.alias("high")).where("low <= high").select("family", "c", "plus", "nuc", "tf", F.explode(F.sequence("low", "high")).alias("pos"))
    pos = F.when(F.col("plus"), F.col("pos")).otherwise(size - 1 - F.col("pos"))
    counted = spans.groupBy("family", "c", pos.alias("pos")).agg(F.sum("nuc").alias("nuc"), F.sum("tf").alias("tf"))
    return counted.select(F.explode(_groups()).alias("grp"), "pos", "nuc", "tf").groupBy("grp", "pos").agg(F.sum("nuc").alias("nuc"), F.sum("tf").alias("tf"))


def stacking_counts(fragments: DataFrame, elements: DataFrame) -> DataFrame:
    """(grp, overlaps, n_nuc, n_tf): overlaps of fragments with elements, and how many of these count for either kind."""
    hits = _on_elements(fragments, elements)
    counted = hits.groupBy("family", "c").agg(F.count("*").alias("overlaps"), F.count_if(F.col("nuc") > 0).alias("n_nuc"), F.count_if(F.col("tf") > 0).alias("n_tf"))
    return counted.select(F.explode(_groups()).alias("grp"), "overlaps", "n_nuc", "n_tf").groupBy("grp").agg(*[F.sum(c).alias(c) for c in ("overlaps", "n_nuc", "n_tf")])


def _on_elements(fragments: DataFrame, elements: DataFrame) -> DataFrame:
    weighted = fragments.drop("plus").withColumn("nuc", length_weight(F.col("length"), "nuc")).withColumn("tf", length_weight(F.col("length"), "tf")).where("nuc > 0 OR tf > 0")
    closed = as_right(elements.withColumn("end", F.col("end") + 1))
    return overlap(weighted, closed.withColumn("e0", F.col("r_start")).withColumn("c", F.col("r_chrom")))


def _groups() -> Column:
    return F.array(F.lit("Global_All"), F.concat(F.lit("Family_"), "family"), F.concat(F.lit("Chr"), "c", F.lit("_All")))
