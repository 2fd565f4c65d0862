"""Row types of elements and issues."""

ELEMENT = "doc_id long, seq long, type string, content string, x0 double, y0 double, x1 double, y1 double, page_num int, region string"
ISSUE = "doc_id long, seq long, issue_type string, severity string, page string, x0 double, y0 double, x1 double, y1 double, evidence string, message string"
SPAN = "array<struct<text: string, size: double>>"
LINE = f"array<struct<bbox: array<double>, spans: {SPAN}>>"
BLOCK = f"array<struct<type: int, bbox: array<double>, lines: {LINE}>>"
ISSUE_COLUMNS = [c.split()[0] for c in ISSUE.split(", ")]


def vector_report(embedding, width: int = 768):
    """Whether an embedding has the wanted width: ok, null or the width it has."""
    from pyspark.sql import functions as F

    return F.when(embedding.isNull(), "null").when(F.size(embedding) == width, "ok").otherwise(F.size(embedding).cast("string"))


def schema_report(df, wanted: str) -> list[tuple[str, str, str]]:
    """Differences between a table and a wanted schema: (column, wanted type or "", type there or "")."""
    from pyspark.sql.types import StructType

    want = {f.name: f.dataType.simpleString() for f in StructType.fromDDL(wanted)}
    have = dict(df.dtypes)
    return sorted((c, want.get(c, ""), have.get(c, "")) for c in want.keys() | have.keys() if want.get(c) != have.get(c))
