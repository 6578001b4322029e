"""Field validators: issues, cleaned value, adjusted confidence; country-code repair; import states."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from millrace.functions.dates import age_years, expiry_state, parsed
from millrace.functions.mrz import let
from millrace.functions.rules import codes, text

#: The country codes that documents may bear, in the order of the countries' names.
COUNTRY_CODES = """
AFG ALB DZA AND AGO ARG ARM AUS AUT AZE BHS BHR BGD BRB BLR BEL BLZ BEN BTN BOL BIH BWA BRA BRN BGR
BFA BDI CPV KHM CMR CAN CAF TCD CHL CHN COL COM COD COG CRI CIV HRV CUB CYP CZE DNK DJI DMA DOM ECU
EGY SLV GNQ ERI EST SWZ ETH FJI FIN FRA GAB GMB GEO DEU GHA GRC GRD GTM GIN GNB GUY HTI HND HUN ISL
IND IDN IRN IRQ IRL ISR ITA JAM JPN JOR KAZ KEN KIR PRK KOR KWT KGZ LAO LVA LBN LSO LBR LBY LIE LTU
LUX MDG MWI MYS MDV MLI MLT MHL MRT MUS MEX FSM MDA MCO MNG MNE MAR MOZ MMR NAM NRU NPL NLD NZL NIC
NER NGA MKD NOR OMN PAK PLW PAN PNG PRY PER PHL POL PRT QAT ROU RUS RWA KNA LCA VCT WSM SMR STP SAU
SEN SRB SYC SLE SGP SVK SVN SLB SOM ZAF SSD ESP LKA SDN SUR SWE CHE SYR TJK TZA THA TLS TGO TON TTO
TUN TUR TKM TUV UGA UKR ARE GBR USA URY UZB VUT VAT VEN VNM YEM ZMB ZWE UTO XOM XXA XXB XXX
""".split()
#: Codes that are repaired one for one, then the beginnings of those that are repaired by pattern, in order.
COUNTRY_REPAIRS = {"VNB": "VNM", "VNA": "VNM", "VNAA": "VNM", "VNMA": "VNM", "VNN": "VNM", "VNM": "VNM"}
COUNTRY_BEGINNINGS = {"VN": "VNM", "UT": "UTO", "D": "DEU", "FR": "FRA", "GB": "GBR", "US": "USA", "CN": "CHN", "J": "JPN", "K": "KOR", "I": "IND", "TH": "THA", "S": "SGP", "M": "MYS"}

NAME_LETTERS = "A-Za-zÀ-ÖØ-öø-ÿĀ-ɏ\\s'\\-."


def repair_country(v: Column) -> Column:
    """A known code, what a code is repaired to, or null; anything but letters and digits is left out first."""

    def repaired(c: Column) -> Column:
        out = F.when(~F.length(c).between(2, 4), None).when(c.isin(*COUNTRY_CODES), c)
        for wrong, right in COUNTRY_REPAIRS.items():
            out = out.when(c == wrong, right)
        return reduce(lambda o, p: o.when((F.length(c) == 3) & c.startswith(p[0]), p[1]), COUNTRY_BEGINNINGS.items(), out)

    return let(F.regexp_replace(F.upper(F.trim(text(v))), "[^A-Z0-9]", ""), repaired)


def repair_nationality(nationality: Column, issuing: Column) -> Column:
    """The repaired nationality, or the issuing country's code, or what was there."""
    return F.coalesce(repair_country(nationality), F.when(F.upper(text(issuing)).isin(*COUNTRY_CODES), F.upper(issuing)), text(nationality))


def clean_noise(v: Column) -> Column:
    """A name without what is no letter of one at its ends."""
    trimmed = F.trim(text(v))
    return F.trim(F.regexp_replace(F.regexp_replace(trimmed, f"(?<=[{NAME_LETTERS}])[^{NAME_LETTERS}]+$", ""), f"^[^{NAME_LETTERS}]+(?=.)", ""))


def _result(value: Column, confidence: Column, corrected: Column, digits_passed: Column, zone_valid: Column, errors: Column, warnings: Column) -> Column:
    adjusted = F.when(corrected, F.greatest(F.lit(0.0), confidence - 0.1)).otherwise(confidence)
    adjusted = F.when(digits_passed, F.least(F.lit(1.0), adjusted + 0.15)).when(zone_valid, F.least(F.lit(1.0), adjusted + 0.075)).otherwise(adjusted)
    bad = F.size(errors) > 0
    return F.struct(value.alias("value"), F.concat(errors, warnings).alias("issues"), adjusted.alias("confidence"), (~bad & (adjusted >= 0.4)).alias("valid"), (bad | (adjusted < 0.7)).alias("needs_review"))


def validate_field(kind: str, v: Column, confidence: Column, as_of: str, corrected: Column | None = None, digits_passed: Column | None = None, zone_valid: Column | None = None) -> Column:
    """value, issues, confidence, valid, needs_review of one field; kind: name, passport, country, birth, expiry or gender."""
    no = F.lit(False)
    corrected, digits_passed, zone_valid = corrected if corrected is not None else no, digits_passed if digits_passed is not None else no, zone_valid if zone_valid is not None else no
    raw = text(v)
    blank = F.trim(raw) == ""
    value, fixed = raw, corrected
    if kind == "name":
        value = clean_noise(raw)
        errors = codes((blank, "FIELD_EMPTY"), (~blank & ~value.rlike(f"^[{NAME_LETTERS}]+$"), "INVALID_FORMAT"))
        warnings = codes(((value != raw) & (value != ""), "TRAILING_OCR_NOISE"), (F.length(raw) > 100, "TOO_LONG"))
    elif kind == "passport":
        value = F.replace(F.upper(F.trim(raw)), F.lit("<"), F.lit(""))
        errors = codes((blank, "FIELD_EMPTY"), (~blank & ~value.rlike("^[A-Z0-9]{5,20}$"), "INVALID_FORMAT"))
        warnings = codes((~blank & (value != raw), "PASSPORT_NORMALIZED"), (value.rlike("[OIL]"), "AMBIGUOUS_CHARS"))
    elif kind == "country":
        cleaned = F.upper(F.trim(raw))
        better = repair_country(raw)
        known = cleaned.isin(*COUNTRY_CODES)
        value = F.when(known, cleaned).otherwise(F.coalesce(better, cleaned))
        fixed = corrected | F.coalesce(~known & better.isNotNull(), no)
        errors = codes((blank, "FIELD_EMPTY"), (~blank & (F.length(value) != 3), "INVALID_LENGTH"))
        warnings = codes((~blank & ~known & better.isNotNull(), "COUNTRY_CODE_REPAIRED"), (~blank & ~known & better.isNull(), "UNRECOGNIZED_COUNTRY"))
    elif kind == "birth":
        d, age = parsed(v), age_years(v, as_of)
        errors = codes((blank, "FIELD_EMPTY"), (~blank & d.isNull(), "INVALID_DATE"), (d > F.lit(as_of).cast("date"), "FUTURE_DATE"))
        warnings = codes((F.year(d) < 1900, "UNUSUALLY_OLD"), ((age > 120) | (age < 0), "UNUSUAL_AGE"))
    elif kind == "expiry":
        state = expiry_state(v, as_of)
        errors = codes((blank, "FIELD_EMPTY"), (~blank & parsed(v).isNull(), "INVALID_DATE"), (state == "EXPIRED", "EXPIRED"))
        warnings = codes((state == "EXPIRING", "EXPIRING_SOON"))
    else:
        errors = codes((blank, "FIELD_EMPTY"), (~blank & ~raw.isin("M", "F", "X", "UNKNOWN"), "INVALID_GENDER"))
        warnings = codes((raw == "UNKNOWN", "GENDER_UNKNOWN"))
    return _result(value, confidence, fixed, digits_passed, zone_valid, errors, warnings)


def import_status(raw: Column, document: Column, passport: Column, card: Column) -> Column:
    """A known state in any spelling; else MISSING_DATA for a blank state whose document has no number, else NEED_REVIEW."""
    name = F.regexp_replace(F.upper(text(raw)), r"[\s_-]", "")
    out = F.when(name == "NEEDREVIEW", "NEED_REVIEW").when(name == "MISSINGDATA", "MISSING_DATA").when(name.isin("READY", "FAILED", "FILLED", "SKIPPED"), name)
    missing = ((document == "PASSPORT") & (text(passport) == "")) | ((document == "ID_CARD") & (text(card) == ""))
    return out.when((text(raw) == "") & missing, "MISSING_DATA").otherwise("NEED_REVIEW")


def check_list(checks: dict[str, Column]) -> Column:
    """Named checks, and whether all passed."""
    rows = F.array(*[F.struct(F.lit(n).alias("name"), F.coalesce(c, F.lit(False)).alias("passed")) for n, c in checks.items()])
    return F.struct(rows.alias("checks"), F.forall(rows, lambda r: r["passed"]).alias("passed"), F.transform(F.filter(rows, lambda r: ~r["passed"]), lambda r: r["name"]).alias("failed"))


def glob_match(pattern: str, v: Column) -> Column:
    """* stands for any text, matched anywhere; a pattern without one is a substring."""
    if "*" not in pattern:
        return text(v).contains(pattern)
    special = "\\.+?^${}()|[]"
    return text(v).rlike(".*".join("".join("\\" + c if c in special else c for c in part) for part in pattern.split("*")))


def merged_options(options: Column, defaults: dict[str, str]) -> Column:
    """defaults with the map's own values over them; other keys go."""
    return F.create_map(*[x for k, d in defaults.items() for x in (F.lit(k), F.coalesce(F.try_element_at(options, F.lit(k)), F.lit(d)))])


def accuracy(confidence: Column, caps: list[tuple[Column, float]]) -> Column:
    """The least of the caps whose conditions hold, blended with the recogniser's confidence: the surer it is, the less it moves the score."""
    least = reduce(lambda a, p: F.least(a, F.when(p[0], F.lit(p[1])).otherwise(F.lit(1.0))), caps, F.lit(1.0))
    weight = F.when(confidence >= 0.9, 0.3).when(confidence >= 0.7, 0.4).otherwise(0.5)
    return least * (1 - weight) + confidence * weight
