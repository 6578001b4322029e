"""What recognisers return, turned into records: nested fields into a guest's row, a zone's parse with its checks. Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from millrace.functions.rules import text
from millrace.functions.text import join_codes

#: Fields of a result and the columns of a guest's row that take their values.
COLUMNS = {"fullName": "fullName", "lastName": "surname", "firstName": "givenName", "passportNumber": "passportNumber", "idNumber": "idNumber", "nationality": "nationality", "dateOfBirth": "dateOfBirth", "issuingCountry": "issuingCountry"}


def _known(v: Column) -> Column:
    return F.when(text(v) != "", v).otherwise("UNKNOWN")


def field_confidences(fields: Column) -> Column:
    """The confidence of each field that is there, by its name; fields is a map to (value, confidence)."""
    return F.transform_values(F.map_filter(fields, lambda _, f: f.isNotNull()), lambda _, f: f["confidence"])


def guest_record(fields: Column, document: Column, gender: Column, overall: Column, level: Column, warnings: Column) -> Column:
    """A guest's row from a result whose fields are a map to (value, confidence).

    The expiry date goes to the passport's or the card's column by the document's type, and to the passport's if the
    type is unknown and there is one. status: FAILED without any value, NEED_REVIEW for an expired document,
    MISSING_DATA for a missing required field, NEED_REVIEW at level LOW, else READY. A null map or null warnings
    count as empty; fields that are not there are null, but the full name, which is empty.
    """
    fields = F.coalesce(fields, F.create_map().cast("map<string,struct<value:string,confidence:double>>"))
    warnings = F.coalesce(warnings, F.array().cast("array<string>"))

    def value(name: str) -> Column:
        return F.try_element_at(fields, F.lit(name))["value"]

    kind, expiry = _known(document), value("expiryDate")
    filled = F.exists(F.map_values(fields), lambda f: text(f["value"]) != "")
    status = F.when(~filled, "FAILED").when(F.array_contains(warnings, "DOCUMENT_EXPIRED"), "NEED_REVIEW").when(F.array_contains(warnings, "MISSING_REQUIRED_FIELD"), "MISSING_DATA").when(level == "LOW", "NEED_REVIEW").otherwise("READY")
    columns = {target: value(name) for name, target in COLUMNS.items()} | {
        "gender": _known(gender), "documentType": kind, "status": status, "confidenceScore": overall, "confidenceLevel": level,
        "fieldConfidence": field_confidences(fields), "ocrWarning": join_codes(warnings, "service"),
        "passportExpiryDate": F.when((kind == "PASSPORT") | ((kind != "ID_CARD") & (text(expiry) != "")), expiry), "idExpiryDate": F.when(kind == "ID_CARD", expiry),
    }
    columns["fullName"] = text(columns["fullName"])
    return F.struct(*[c.alias(n) for n, c in columns.items()])


#: The validator's checks and the names that a parsed record has them under.
CHECKS = {
    "passport_number": "passport_number_valid",
    "date_of_birth": "date_of_birth_valid",
    "expiry_date": "expiry_date_valid",
    "optional_data": "optional_data_valid",
    "composite": "final_composite_valid",
    "overall": "overall_valid",
}


def merged_checks(validator: dict[str, Column], parser: Column) -> Column:
    """The validator's checks under the record's names, with the parser's own map over them; a null map has none."""
    own = F.create_map(*[x for name, key in CHECKS.items() for x in (F.lit(key), F.coalesce(validator[name], F.lit(False)))])
    parser = F.coalesce(parser, F.create_map().cast("map<string,boolean>"))
    return F.map_zip_with(own, parser, lambda _, mine, theirs: F.coalesce(theirs, mine))


def parsed_record(parse: Column, checks: Column, lines: Column) -> Column:
    """A zone's parse renamed to a document's fields: the number twice, optional data as the card's number, no issue date, the raw text and lines, checks."""
    names = {
        "fullName": "full_name", "surname": "surname", "givenName": "given_names", "gender": "sex", "dateOfBirth": "date_of_birth", "nationality": "nationality", "issuingCountry": "issuing_country",
        "passportNumber": "passport_number", "documentNumber": "passport_number", "idNumber": "optional_data", "expiryDate": "expiry_date",
    }
    return F.struct(*[parse[source].alias(n) for n, source in names.items()], F.lit("").alias("issueDate"), F.array_join(lines, "\n").alias("mrzRaw"), lines.alias("mrzParsed"), checks.alias("checkDigits"))
