"""What recognisers give: staged passes, pairs of near lines, confidence over fields, boxes into lines, and classes by rules."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions import mrz, visual
from millrace.operators import windows
from millrace.sources.tables import written


def near_pairs(rows: DataFrame, by: list[str], position: str, reach: int = 20) -> DataFrame:
    """by, a, b: for rows of one group whose positions are apart by less than reach, the earlier row's columns and the later one's, as structs.

    A block is reach positions long, so a partner is in the row's own block or the next: each row is sent to its
    own block and the one before, and the join is one of equal keys, with no loop over a group. Positions are
    whole numbers; rows at the same position are no pair. Null positions pair with nothing.
    """
    rest = [c for c in rows.columns if c not in by]
    block = F.floor(F.col(position) / reach)
    early = rows.select(*by, block.alias("_block"), F.struct(*rest).alias("a")).where("_block is not null")
    late = rows.select(*by, F.explode(F.array(block, block - 1)).alias("_block"), F.struct(*rest).alias("b")).where("_block is not null")
    paired = early.join(late, [*by, "_block"])
    return paired.where((F.col(f"a.{position}") < F.col(f"b.{position}")) & (F.col(f"b.{position}") - F.col(f"a.{position}") < reach)).select(*by, "a", "b")


def crossings(segments: DataFrame, by: list[str], position: str, width: Column, height: Column, least: float = 10.0, most: float = 170.0, reach: int = 20) -> DataFrame:
    """by, crossed, score: pairs of near segments (x1, y1, x2, y2) whose steepness differs by between least and most degrees, and their number over the picture's diagonal, 1 at most. Groups without such a pair have 0."""
    steep = segments.withColumn("_angle", F.abs(F.atan2(F.col("y2") - F.col("y1"), F.col("x2") - F.col("x1")))).select(*by, position, "_angle")
    apart = F.degrees(F.abs(F.col("a._angle") - F.col("b._angle")))
    crossed = near_pairs(steep, by, position, reach).where((apart > least) & (apart < most)).groupBy(*by).agg(F.count("*").alias("crossed"))
    groups = segments.groupBy(*by).agg(F.sqrt(F.max(width) ** 2 + F.max(height) ** 2).alias("_diagonal"))
    score = F.least(F.lit(1.0), F.col("crossed") / F.greatest("_diagonal", F.lit(1.0)))
    return groups.join(crossed, by, "left").na.fill(0, ["crossed"]).select(*by, "crossed", score.alias("score"))


def reading_score(confidence: Column, valid: Column, lines: Column) -> Column:
    """Six tenths of the mean confidence, four tenths for a zone whose digits hold, a tenth for three lines or more, less for fewer."""
    return confidence * 0.6 + F.when(valid, 0.4).otherwise(0.0) + F.least(lines / 3, F.lit(1.0)) * 0.1


def staged(rows: DataFrame, key: str, stages: dict[str, Callable[[DataFrame], DataFrame]], score: str = "score", order: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """The best result for each key, with the stage that gave it and whether it was a fallback; and the rows for which no stage gave any.

    A stage takes rows and gives results: any number for each row, with key and score. A stage's results are
    written, and the next one gets only the rows whose key has none: it computes nothing for the others. Of a
    key's results the one with the largest score is taken, order and then the stage's own columns deciding ties. Rows
    with a null key, and null keys in results, are left with the rest.
    """
    rest, all_results = rows, None
    for place, (name, stage) in enumerate(stages.items()):
        results = stage(rest)
        own = [c for c in results.columns if c not in (key, score, *order)]
        got = written(results.where(F.col(key).isNotNull()).withColumns({"stage": F.lit(name), "fallback": F.lit(place > 0)}), f"stage-{name}")
        best = windows.best(got, [key], score, [*order, *own])
        all_results = best if all_results is None else all_results.unionByName(best)
        rest = rest.join(got.select(key).distinct(), key, "left_anti").select(rows.columns)
    return all_results, rest


#: For each format, where a field lies: line and place, from 1 to the end; a second line's part on its own.
_LINE1 = {"TD3": 44, "TD2": 36, "TD1": 30}
_OPTIONAL = {"TD3": [(2, 28, 42)], "TD2": [(2, 28, 35)], "TD1": [(2, 28, 30), (3, 0, 30)]}
_LINE2 = {"passport_number": (0, 9), "nationality": (10, 13), "date_of_birth": (13, 19), "gender": (20, 21), "expiry_date": (21, 27)}
PLACES = [
    (fmt, name, line, start, end)
    for fmt in _LINE1
    for name, line, start, end in [("issuing_country", 1, 2, 5), ("names", 1, 5, _LINE1[fmt]), *((n, 2, a, b) for n, (a, b) in _LINE2.items()), *(("optional_data", *p) for p in _OPTIONAL[fmt])]
]
EMPTY_PENALTY = 0.3


def aligned_confidence(lines: DataFrame, spans: DataFrame, key: str) -> DataFrame:
    """key, field, value, confidence for each field of each zone.

    lines(key, line from 1, text); spans(key, line, start, end, confidence) are stretches of a line, start and
    end counted from 0 and end exclusive. A field's confidence is the mean of the spans that it meets, weighted by
    how many of its characters each covers; over two lines, the mean of the two; 0 where no span reaches. An
    empty field, or one of fillers, has 0.3 less, 0 at least. Surname and given name are the names' parts before and
    behind the first pair of fillers, and each takes the spans over its own part. Spans that overlap count each.
    Zones too short for any format have no rows; a third line counts for TD1 only where it is there.
    """
    texts = lines.groupBy(key).agg(*[F.max(F.when(F.col("line") == k, F.col("text"))).alias(f"_t{k}") for k in (1, 2, 3)])
    t1, t2, t3 = (F.coalesce(F.col(f"_t{k}"), F.lit("")) for k in (1, 2, 3))
    fmt = mrz.line_format(t1, t2, F.rpad(t3, 30, "<"), "service")
    places = F.create_map(*[x for f in _LINE1 for x in (F.lit(f), F.array(*[F.struct(F.lit(n).alias("field"), F.lit(k).alias("line"), F.lit(a).alias("start"), F.lit(b).alias("end")) for g, n, k, a, b in PLACES if g == f]))])
    zones = texts.select(key, t1.alias("_t1"), t2.alias("_t2"), t3.alias("_t3"), fmt.alias("_fmt")).where("_fmt is not null")
    parts = zones.select(key, "_fmt", "_t1", "_t2", "_t3", F.explode(F.element_at(places, F.col("_fmt"))).alias("_p")).select(key, "_fmt", "_t1", "_t2", "_t3", "_p.*")
    text = F.when(F.col("line") == 1, F.col("_t1")).when(F.col("line") == 2, F.col("_t2")).otherwise(F.col("_t3"))
    parts = parts.withColumn("raw", F.substring(text, F.col("start") + 1, F.col("end") - F.col("start"))).where((F.col("line") < 3) | (F.col("_t3") != ""))
    # The names' own three fields.
    cut = F.position(F.lit("<<"), F.col("raw"))
    length = F.when(cut > 0, cut - 1).otherwise(F.length("raw"))
    behind = F.when(cut > 0, F.substring(F.col("raw"), cut + 2, F.length("raw"))).otherwise("")
    named = F.array(
        F.struct(F.lit("surname").alias("field"), F.col("start").alias("start"), (F.col("start") + length).alias("end"), F.substring(F.col("raw"), F.lit(1), length).alias("raw")),
        F.struct(F.lit("given_name").alias("field"), F.least(F.col("start") + length + 2, F.col("end")).alias("start"), F.col("end").alias("end"), behind.alias("raw")),
        F.struct(F.lit("full_name").alias("field"), F.col("start").alias("start"), F.col("end").alias("end"), F.col("raw").alias("raw")),
    )
    same = F.array(F.struct("field", "start", "end", "raw"))
    parts = parts.withColumn("_f", F.explode(F.when(F.col("field") == "names", named).otherwise(same))).select(key, "_fmt", "line", "_f.*")
    shown = spans.select(key, "line", F.col("start").alias("_from"), F.col("end").alias("_to"), F.col("confidence").alias("_c"))
    met = parts.join(shown, [key, "line"], "left")
    # A name's part that is empty still takes what lies where it would stand.
    end = F.greatest(F.col("end"), F.col("start") + 1)
    over = F.greatest(F.least(end, F.col("_to")) - F.greatest(F.col("start"), F.col("_from")), F.lit(0))
    by_line = met.groupBy(key, "_fmt", "field", "line").agg(F.first("raw").alias("raw"), F.sum(over * F.col("_c")).alias("_sum"), F.sum(over).alias("_n"))
    mean = F.coalesce(F.when(F.col("_n") > 0, F.col("_sum") / F.col("_n")), F.lit(0.0))
    whole = by_line.groupBy(key, "_fmt", "field").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "raw"))), lambda p: p["raw"]), "").alias("raw"), F.avg(mean).alias("_mean"))
    spaced = F.trim(F.replace("raw", F.lit("<"), F.lit(" ")))
    names = F.split("raw", "<<")
    first = F.trim(F.replace(names[0], F.lit("<"), F.lit(" ")))
    second = F.trim(F.replace(F.array_join(F.slice(names, F.lit(2), F.size(names)), "<"), F.lit("<"), F.lit(" ")))
    both = F.concat_ws(" ", F.nullif(first, F.lit("")), F.nullif(second, F.lit("")))
    plain = F.when(F.col("field").isin("surname", "given_name"), spaced).when(F.col("field") == "full_name", both)
    plain = plain.when((F.col("field") == "optional_data") & (F.col("_fmt") == "TD1"), spaced).when(F.col("field").isin("date_of_birth", "expiry_date", "gender"), F.col("raw")).otherwise(F.trim(F.replace("raw", F.lit("<"), F.lit(""))))
    empty = F.trim(F.replace("raw", F.lit("<"), F.lit(""))) == ""
    return whole.select(key, "field", plain.alias("value"), F.when(empty, F.greatest(F.col("_mean") - EMPTY_PENALTY, F.lit(0.0))).otherwise(F.col("_mean")).alias("confidence"))


def lines_of_boxes(boxes: DataFrame, by: list[str], text: str = "text", confidence: str = "confidence", trust: float = 0.5, least: int = 15, order: tuple[str, ...] = ()) -> DataFrame:
    """by, line (from 1, top to bottom), text, confidence of boxes (left, top, bottom).

    Boxes are on one line while their middles, from the top down, are no further apart than six tenths of the upper
    median of the group's heights, 3 at least. Within a line they go from left to right; those trusted less than
    trust, or whose confidence is null, and white space drop out. Only letters, digits and fillers stay, capital or
    not, and come out in capitals; lines of fewer than least characters go. confidence is the mean of the boxes
    that make the line. order decides ties. A group is one page's boxes.
    """
    tied = [F.col(c) for c in order]
    sized = boxes.withColumns({"_middle": (F.col("top") + F.col("bottom")) / 2, "_height": F.col("bottom") - F.col("top")}).where("_middle is not null")
    heights = windows.upper_medians(sized, by, "_height").select(*[F.col(b).alias(f"_b{k}") for k, b in enumerate(by)], F.greatest(F.col("middle") * 0.6, F.lit(3.0)).alias("_tolerance"))
    on = [F.col(b).eqNullSafe(F.col(f"_b{k}")) for k, b in enumerate(by)]
    placed = sized.join(heights, on).drop(*[f"_b{k}" for k in range(len(by))])
    w = Window.partitionBy(*by).orderBy("_middle", *tied)
    fresh = F.coalesce((F.col("_middle") - F.lag("_middle").over(w) > F.col("_tolerance")).cast("int"), F.lit(0))
    numbered = placed.withColumn("_fresh", fresh).withColumn("line", (F.sum("_fresh").over(w.rowsBetween(Window.unboundedPreceding, 0)) + 1).cast("long"))
    word = F.regexp_replace(F.upper(F.coalesce(F.col(text), F.lit(""))), r"\s", "")
    trusted = numbered.where((F.col(confidence) >= trust) & (word != "")).withColumn("_word", word)
    items = F.array_sort(F.collect_list(F.struct("left", *order, "_word")))
    joined = trusted.groupBy(*by, "line").agg(F.upper(F.regexp_replace(F.array_join(F.transform(items, lambda i: i["_word"]), ""), "[^A-Z0-9<]", "")).alias("text"), F.avg(confidence).alias("confidence"))
    return joined.where(F.length("text") >= least)


def line_runs(profile: DataFrame, by: list[str], order: str, value: str, threshold: float, least: int, width: int = 3) -> DataFrame:
    """by, lines: how many runs of the smoothed profile are at threshold or above and least rows long."""
    smooth = windows.moving_average(profile, by, order, value, width)
    runs = windows.bands(smooth, by, order, "smooth", threshold, least).groupBy(*by).agg(F.count("*").alias("lines"))
    return profile.select(*by).distinct().join(runs, by, "left").na.fill(0, ["lines"])


def classified(rows: DataFrame, key: list[str], rules: DataFrame, features: list[str], floor: int = 30, forced: str | None = None, top: int = 1) -> DataFrame:
    """key, label, points, share, rank, signals: classes by rules over features.

    rules(label, place, signal, feature, low, high, points): a rule holds where its feature lies between low and high,
    both exclusive, null for no bound; points are hundredths. Features go into long form and meet their rules by name;
    only the bounds are compared row by row. Labels with less than floor points go; share is a label's part of all the
    points that are left; ranks go by points, then by place. forced names a column whose value, where it is not null, is the
    label, with 100 points and the signal FORCED_MODE. Rows without a label at all have one row with null label and 0 points.
    """
    kept = rows.select(*key, *features, *([F.col(forced).alias("_forced")] if forced else [F.lit(None).cast("string").alias("_forced")]))
    long = kept.where("_forced is null").unpivot(key, features, "feature", "_value").where("_value is not null")
    inside = (F.col("low").isNull() | (F.col("_value") > F.col("low"))) & (F.col("high").isNull() | (F.col("_value") < F.col("high")))
    # Rules are a few rows that a program states.
    held = long.join(F.broadcast(rules), "feature").where(inside)
    scored = held.groupBy(*key, "label", "place").agg(F.least(F.sum("points"), F.lit(100)).cast("int").alias("points"), F.array_sort(F.collect_list("signal")).alias("signals")).where(F.col("points") >= floor)
    w = Window.partitionBy(*key)
    ranked = scored.withColumns({"share": F.col("points") / F.sum("points").over(w), "rank": F.row_number().over(w.orderBy(F.desc("points"), "place"))}).where(F.col("rank") <= top).drop("place")
    told = kept.where("_forced is not null").select(*key, F.col("_forced").alias("label"), F.lit(100).alias("points"), F.array(F.lit("FORCED_MODE")).alias("signals"), F.lit(1.0).alias("share"), F.lit(1).alias("rank"))
    every = kept.where("_forced is null").select(*key).join(ranked, key, "left")
    every = every.withColumns({"points": F.coalesce("points", F.lit(0)), "share": F.coalesce("share", F.lit(0.0)), "rank": F.coalesce("rank", F.lit(1)), "signals": F.coalesce("signals", F.array().cast("array<string>"))})
    return every.unionByName(told)


def visual_records(rows: DataFrame, text: str, script: str | None = None, out: str = "record") -> DataFrame:
    """rows with the struct out of a document's text: surname, given_name, full_name, passport_number, nationality, date_of_birth, gender, expiry_date, zone_found.

    Values behind labels come first (visual.labelled_fields); names in another script than Latin, where the column script
    says that the country writes so, are transliterated if that is trusted more than half; then what a zone in the
    same text says, repaired, is laid over wherever it says something. Without a zone the gender is UNKNOWN. A null
    text gives empty fields.
    """
    foreign = F.upper(F.col(script)) if script else F.lit("LATIN")
    read = windows.materialised(rows, "_fields", visual.labelled_fields(F.col(text)))
    read = windows.materialised(read, "_whole", visual.with_full_name(F.col("_fields")))
    read = windows.materialised(read, "_latin", visual.transliterated(F.col("_whole"), foreign))
    read = windows.materialised(read, "_zone", visual.zone_lines(F.col(text)))
    read = windows.materialised(read, "_line2", F.when(F.col("_zone").isNotNull(), mrz.repair_line2(F.col("_zone.l2"))["line2"]))
    zone = F.when(F.col("_zone").isNotNull(), mrz.parse(F.col("_zone.l1"), F.col("_line2"), F.lit(""), F.lit("TD3")))
    read = windows.materialised(read, "_parsed", zone)
    told = F.col("_parsed")
    found = told.isNotNull() & ((told["surname"] != "") | (told["passport_number"] != ""))
    names = {"surname": "surname", "given_name": "given_names", "full_name": "full_name"}
    others = {"passport_number": "passport_number", "nationality": "nationality", "date_of_birth": "date_of_birth", "expiry_date": "expiry_date"}

    def over(name: str, source: str) -> Column:
        value = told[source]
        return F.when(found & (value != ""), visual.clean_name(value) if name in names else value).otherwise(F.col(f"_latin.{name}")).alias(name)

    fields = [over(n, s) for n, s in (names | others).items()]
    gender = F.when(found, told["sex"]).otherwise("UNKNOWN").alias("gender")
    return read.select(*[F.col(f"`{c}`") for c in rows.columns], F.struct(*fields, gender, F.coalesce(found, F.lit(False)).alias("zone_found")).alias(out))


def collated(v: Column, marks: bool = True) -> Column:
    """v to be ordered as readers do, by the collation of Unicode: case does not part names, nor do marks unless marks."""
    return F.collate(v, "UNICODE_CI" if marks else "UNICODE_CI_AI")
