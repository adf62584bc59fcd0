"""The four things the engine does, on documents made here: python examples/process.py"""

from pyspark.sql import SparkSession

from arborq import api

NOTE = "<!ELEMENT note (to,body?)><!ELEMENT to (#PCDATA)><!ELEMENT body (#PCDATA)><!ATTLIST note id CDATA #IMPLIED>"


def main(spark):
    docs = spark.createDataFrame([(1, '<note id="7"><to>Ada</to></note>'), (2, "<note><cc/></note>"), (3, "<note>")], "doc_id int, source string")
    api.process(docs).show(truncate=False)  # well-formed or not
    notes = api.project(docs, api.compile_dtd(NOTE))  # typed by a schema
    notes.verdicts.show(truncate=False)
    notes.typed("Note").select("doc_id", "message.id", "message.to.text").show()
    feeds = spark.createDataFrame([(1, '<rss version="2.0"><channel><title>t</title><item/></channel></rss>')], "doc_id int, source string")
    api.rss_report(feeds).show(truncate=False)
    api.generate(api.parse(docs)).show(truncate=False)  # and back to text


if __name__ == "__main__":
    main(SparkSession.builder.master("local[2]").getOrCreate())
