"""Registered queries over packages made from ``nation``: an archive for each, some broken in one way or another."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import functions as F

from arborq.plans.formats import format_schema
from arborq.sources.packages import content_types, parts_of, process_packages, relationships, with_types


def _packages(spark, d):
    """By ``n_nationkey % 5``: 1 has a malformed part, 2 is no archive, 3 has a malformed list of content types."""

    def run(batches):
        import io
        import zipfile

        for batch in batches:
            out = []
            for k, name in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                buffer = io.BytesIO()
                with zipfile.ZipFile(buffer, "w") as z:
                    z.writestr("[Content_Types].xml", '<Types xmlns="t"><Default Extension="PNG" ContentType="image/png"/><Override PartName="/word/document.xml" ContentType="a/b+xml"/>' + ("</Types>" if k % 5 != 3 else ""))
                    z.writestr("_rels/.rels", '<Relationships xmlns="r"><Relationship Id="i" Type="t" Target="word/document.xml"/></Relationships>')
                    z.writestr("word/_rels/document.xml.rels", f'<Relationships xmlns="r"><Relationship Id="a" Type="t" Target="../media/{k}.png"/><Relationship Id="b" Type="u" Target="http://x" TargetMode="External"/></Relationships>')
                    z.writestr("word/document.xml", f'<w:document xmlns:w="w"><w:body><w:p><w:r><w:t>{name}</w:t></w:r></w:p></w:body>' + ("" if k % 5 == 1 else "</w:document>"))
                    z.writestr(f"media/{k}.png", b"\x89")
                    z.writestr("custom/item.xml", "<zz/>")
                out.append(buffer.getvalue() if k % 5 != 2 else b"PK no archive")
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], ["package_id", "content"])

    rows = spark.read.parquet(f"{d}/nation.parquet").select(F.col("n_nationkey").cast("long").alias("package_id"), "n_name")
    return rows.mapInArrow(run, "package_id long, content binary")


def s4_parts(spark, d):
    """Parts of archives; a broken archive is a row with an error."""
    return parts_of(_packages(spark, d)).groupBy("package_id").agg(F.count("name").alias("parts"), F.count("error").alias("errors"))


def o1_packages(spark, d):
    return process_packages(_packages(spark, d)).select("package_id", "package_verdict", "name", "root")


def o2_content_types(spark, d):
    """Types by extension and by part (the lists that can be read)."""
    return content_types(parts_of(_packages(spark, d))).select("package_id", "extension", "part", "type")


def o3_type_of_part(spark, d):
    parts = parts_of(_packages(spark, d))
    return with_types(parts, content_types(parts)).where("name LIKE '%.png' OR name LIKE '/word/doc%' OR name LIKE '/custom/%'").select("package_id", "name", "content_type")


def o5_rel_targets(spark, d):
    """Targets of relationships, resolved against their part's folder."""
    return relationships(parts_of(_packages(spark, d))).select("package_id", "source_part", "id", "resolved")


def o6_part_relationships(spark, d):
    """Relationships that a package's parts carry with them."""
    rows = process_packages(_packages(spark, d)).where("name IS NOT NULL")
    return rows.select("package_id", "name", F.size("rels").alias("of_package"), F.size("part_rels").alias("of_part"))


def o7_routing(spark, d):
    """Parts go to the schema that knows their root, and are projected: the text of the first run of each document part."""
    rows = process_packages(_packages(spark, d), {"docx": format_schema("docx"), "xlsx": format_schema("xlsx")})
    text = F.get_json_object("value", "$.body.entry[0].p.r[0].entry[0].t.text").alias("text")
    return rows.where("format IS NOT NULL").select("package_id", "name", "format", "verdict", text)


QUERIES = {f.__name__: f for f in (s4_parts, o1_packages, o2_content_types, o3_type_of_part, o5_rel_targets, o6_part_relationships, o7_routing)}

_K = "(SELECT CAST(n_nationkey AS BIGINT) AS k, n_name FROM nation)"
_PNG = "'/media/' || k || '.png'"
ORACLE_SQL = {
    "s4_parts": f"SELECT k AS package_id, CAST(CASE WHEN k % 5 = 2 THEN 0 ELSE 6 END AS BIGINT) AS parts, CAST(CASE WHEN k % 5 = 2 THEN 1 ELSE 0 END AS BIGINT) AS errors FROM {_K}",
    "o1_packages": f"""WITH p AS (SELECT k, k % 5 AS m, unnest([{_PNG}, '/word/document.xml', '/custom/item.xml']) AS name FROM {_K})
SELECT k AS package_id, CASE WHEN m = 1 THEN 'NOT_WELL_FORMED' ELSE 'WELL_FORMED' END AS package_verdict, name,
  CASE WHEN name LIKE '/word%' AND m <> 1 THEN 'w:document' WHEN name LIKE '/custom%' THEN 'zz' END AS root FROM p WHERE m NOT IN (2, 3)
UNION ALL SELECT k, 'NOT_A_PACKAGE', NULL, NULL FROM {_K} WHERE k % 5 IN (2, 3)""",
    "o2_content_types": f"SELECT k AS package_id, unnest(['png', NULL]) AS extension, unnest([NULL, '/word/document.xml']) AS part, unnest(['image/png', 'a/b+xml']) AS type FROM {_K} WHERE k % 5 NOT IN (2, 3)",
    "o3_type_of_part": f"""SELECT k AS package_id, unnest([{_PNG}, '/word/document.xml', '/custom/item.xml']) AS name,
  unnest(CASE WHEN k % 5 = 3 THEN [NULL, NULL, NULL] ELSE ['image/png', 'a/b+xml', NULL] END) AS content_type FROM {_K} WHERE k % 5 <> 2""",
    "o5_rel_targets": f"SELECT k AS package_id, unnest(['/', '/word/document.xml', '/word/document.xml']) AS source_part, unnest(['i', 'a', 'b']) AS id, unnest(['/word/document.xml', {_PNG}, NULL]) AS resolved FROM {_K} WHERE k % 5 <> 2",
    "o6_part_relationships": f"SELECT k AS package_id, unnest([{_PNG}, '/word/document.xml', '/custom/item.xml']) AS name, 1 AS of_package, unnest([0, 2, 0]) AS of_part FROM {_K} WHERE k % 5 NOT IN (2, 3)",
    "o7_routing": f"SELECT k AS package_id, '/word/document.xml' AS name, 'docx' AS format, 'VALID' AS verdict, n_name AS text FROM {_K} WHERE k % 5 NOT IN (1, 2, 3)",
}
