"""Rules of the front desk: passport numbers by country, accuracy of numbers, choice of zone lines, options that a report names."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from millrace.functions import mrz
from millrace.functions.dims import ISO2_TO_ISO3
from millrace.functions.rules import codes, level, text
from millrace.functions.text import ambiguity_warnings, lookup

#: What passport numbers look like, by country; of several patterns one must fit.
PASSPORT_NUMBERS = r"""
GBR \d{9}
USA \d{9}
CHN [A-Z]\d{8} [A-Z]\d{7}
JPN [A-Z]{2}\d{7}
KOR \d{8}
RUS \d{9}
ARE [A-Z]{2}\d{7}
VNM [A-Z]\d{7}
IND [A-Z]\d{7}
FRA \d{2}[A-Z]{2}\d{5}
DEU [A-Z]\d{8}
ITA [A-Z]{2}\d{7}
ESP [A-Z]{3}\d{6}
BRA [A-Z]{2}\d{6}
CAN [A-Z]{2}\d{6}
AUS [A-Z]\d{8}
ZAF \d{8}
SGP [A-Z]\d{7}
MYS [A-Z]\d{8}
THA \d{9}
PHL [A-Z]{2}\d{7}
IDN \d{8}
MEX \d{8} [A-Z]\d{7}
TUR [A-Z]\d{8}
NLD [A-Z]{2}\d{7}
SAU [A-Z]\d{8}
CHE \d{8}
SWE \d{8}
NOR \d{8}
DNK \d{7}
FIN [A-Z]{2}\d{7}
BEL [A-Z]{2}\d{6}
AUT \d{8}
PRT \d{8}
GRC [A-Z]{2}\d{7}
IRL \d{9}
NZL [A-Z]{2}\d{6}
POL \d{9}
CZE \d{8}
HUN \d{8}
ROU \d{8}
UKR \d{9}
ISR \d{8}
PAK [A-Z]{2}\d{7}
BGD [A-Z]\d{8}
EGY \d{9}
NGA \d{8}
KEN \d{8}
ARG [A-Z]{3}\d{6}
CHL \d{8}
COL \d{10}
HKG [A-Z]{2}\d{7}
TWN \d{9}
MMR [A-Z]\d{8}
LAO [A-Z]{2}\d{7}
KHM \d{9}
"""
PATTERNS = {row[0]: row[1:] for row in map(str.split, PASSPORT_NUMBERS.strip().splitlines())}


def whole(v: Column, *patterns: str) -> Column:
    """Whether one of the patterns fits from the first to the last character, line ends included."""
    return v.rlike(r"\A(?:" + "|".join(patterns) + r")\z")


def passport_fits(number: Column, nationality: Column) -> Column:
    """Whether a number looks like the country's passports; of an unknown or empty country: five to twenty letters and digits."""
    v = text(number)
    groups: dict[tuple[str, ...], list[str]] = {}
    for c, patterns in PATTERNS.items():
        groups.setdefault(tuple(patterns), []).append(c)
    generic = whole(v, "[A-Za-z0-9]{5,20}")

    def fits(country: Column) -> Column:
        first, *rest = [(country.isin(*of), whole(F.upper(v), *patterns)) for patterns, of in groups.items()]
        return reduce(lambda out, r: out.when(*r), rest, F.when(*first)).otherwise(generic)

    return mrz.let(mrz.let(F.upper(text(nationality)), lambda code: lookup(ISO2_TO_ISO3, code, code)), fits)


def _accuracy(score: Column, issues: Column) -> Column:
    return F.struct(level(score).alias("level"), score.alias("score"), issues.alias("issues"))


def passport_accuracy(number: Column, nationality: Column) -> Column:
    """level, score, issues of a passport number: the least of the caps, from 1 less .05 (.2 at most) for characters that may be misread. Null counts as empty."""
    v = text(number)
    unsure = F.size(ambiguity_warnings(v))
    odd, zeros = ~whole(v, "[A-Za-z0-9]{5,20}"), whole(v, "0+")
    foreign = (text(nationality) != "") & ~passport_fits(v, nationality)
    caps = [F.when(test, F.lit(cap)).otherwise(1.0) for test, cap in ((odd, 0.3), (zeros, 0.1), (foreign, 0.4))]
    score = F.least(1 - F.least(F.lit(0.2), unsure * 0.05), *caps)
    return _accuracy(score, codes((unsure > 0, "AMBIGUOUS_CHARS"), (odd, "INVALID_FORMAT"), (zeros, "ZERO_FILLED"), (foreign, "COUNTRY_FORMAT")))


def card_accuracy(number: Column) -> Column:
    """The same of a card number: .03 (.15 at most) for characters that may be misread, five to thirty letters and digits."""
    v = text(number)
    unsure, odd = F.size(ambiguity_warnings(v)), ~whole(v, "[A-Za-z0-9]{5,30}")
    score = F.least(1 - F.least(F.lit(0.15), unsure * 0.03), F.when(odd, 0.3).otherwise(1.0))
    return _accuracy(score, codes((unsure > 0, "AMBIGUOUS_CHARS"), (odd, "INVALID_FORMAT")))


#: Length of a zone's lines and how many a format has, in the order in which they are looked for.
ZONE_LINES = {44: 2, 36: 2, 30: 3}


def zone_line_score(line: Column) -> Column:
    """How much one line looks like a zone's: by its beginning, length, fillers and digits; 0 for a short one or too many other characters."""
    v = text(line)
    n = F.length(v)
    known, digits = n - F.length(F.regexp_replace(v, "[A-Z0-9<]", "")), n - F.length(F.regexp_replace(v, r"\p{Nd}", ""))
    fillers = n - F.length(F.replace(v, F.lit("<"), F.lit("")))
    begins = F.when(v.startswith("P<"), 30).when(v.startswith("P") & (n >= 40), 15).when(v.startswith("I<") | v.startswith("ID"), 20).when(v.startswith("V<"), 15).otherwise(0)
    length = F.when(n == 44, 35).when(n.isin(36, 30), 25).when(n >= 40, 20).when(n >= 30, 10).otherwise(0)
    many = F.when(fillers >= 5, 10).otherwise(0) + F.when(digits >= 8, 15).when(digits >= 4, 5).otherwise(0)
    return F.when((n < 15) | (known < n * 0.85), 0).otherwise(begins + length + many + mrz.likelihood(v))


def upside_down(lines: Column) -> Column:
    """Whether lines read from their ends: more signs of it than usual beginnings, or any such sign, no usual beginning and two lines or more."""

    def count(v: Column, what: str) -> Column:
        return F.length(v) - F.length(F.regexp_replace(v, what, ""))

    def signs(v: Column) -> Column:
        first, last, n = F.substring(v, 1, 5), F.substring(v, -5, 5), F.length(v)
        ends = F.when(v.rlike("^[PIVABC]>"), 1).otherwise(0) + F.when((n >= 5) & (count(last, r"\p{L}") >= 3), 1).otherwise(0)
        return ends + F.when((n >= 10) & (count(first, r"\p{Nd}") >= 3) & (count(last, r"\p{Nd}") < 2), 2).otherwise(0)

    def total(of) -> Column:
        return F.aggregate(F.transform(lines, of), F.lit(0), lambda a, b: a + b)

    usual, turned = total(lambda v: F.when(v.rlike("^(?:[PIV]<|ID)"), 1).otherwise(0)), total(signs)
    return F.coalesce((turned > usual) | ((turned > 0) & (usual == 0) & (F.size(lines) >= 2)), F.lit(False))


def zone_lines(lines: Column) -> Column:
    """Three lines at most that may be a zone's, of an array of lines without nulls.

    Where enough have the exact length of a format these are taken, in their order, turned round if they read
    from their ends; else the best by zone_line_score, the earlier of equal ones first, equal texts once.
    """

    def of_length(n: int) -> Column:
        return F.filter(lines, lambda v: F.length(v) == n)

    exact = {n: of_length(n) for n in ZONE_LINES}
    best = F.filter(F.transform(lines, lambda v, i: F.struct((-zone_line_score(v)).alias("score"), i.alias("at"), v.alias("line"))), lambda r: r["score"] < 0)
    ranked = F.array_distinct(F.transform(F.array_sort(best), lambda r: r["line"]))
    enough = [(F.size(of) >= ZONE_LINES[n], F.when(upside_down(of), F.transform(of, F.reverse)).otherwise(of)) for n, of in exact.items()]
    chosen = reduce(lambda out, e: out.when(*e), enough[1:], F.when(*enough[0])).otherwise(ranked)
    return F.slice(F.coalesce(chosen, F.array().cast("array<string>")), 1, 3)


#: The options that a report names; the first four are those of the short one.
REPORTED = (
    "documentMode", "enablePassportMrz", "enableIdCardOcr", "concurrency", "enablePassportVisualOcr", "enableQrBarcodeRead",
    "enablePdfInput", "enableDiagnosticsSheet", "deleteTempFiles", "perImageTimeoutSeconds",
)


def report(job: Column, options: Column, summary: Column, errors: Column, short: bool = False, as_of: str | None = None) -> Column:
    """job_id, generated_at (as_of), summary, error_count, and options_used: those of the options map that a report names; a null map has none."""
    named = REPORTED[:4] if short else REPORTED
    used = F.map_filter(F.coalesce(options, F.create_map().cast("map<string,string>")), lambda k, _: k.isin(*named))
    return F.struct(job.alias("job_id"), F.lit(as_of).cast("string").alias("generated_at"), summary.alias("summary"), errors.alias("error_count"), used.alias("options_used"))
