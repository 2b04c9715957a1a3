from __future__ import annotations

from corpusloom.functions import sql
from corpusloom.operators import context
from corpusloom.sources.files import compressed


def test_table_functions(spark):
    sql.register(spark)
    spark.createDataFrame([(1, "a\nb"), (2, "x " * 300)], "id int, t string").createOrReplaceTempView("texts")
    got = [tuple(r) for r in spark.sql("select id, l.line_no, l.content from texts, lateral text_lines(t, 200) l where id = 1 order by l.line_no").collect()]
    assert got == [(1, 0, "a"), (1, 1, "b")]
    assert spark.sql("select count(*) n from texts, lateral text_pieces(t, 100) p where id = 2").first().n > 5
    row = spark.sql("select beta_cdf(0.5D, 0.4D, 0.4D) x, beta_cdf(cast(null as double), 0.4D, 0.4D) y").first()
    assert abs(row.x - 0.5) < 1e-9 and (row.y is None or row.y != row.y)


def test_summaries(spark):
    docs = spark.createDataFrame([("d", "one two " * 6000, "de"), ("e", "short", "en")], "doc_id string, text string, lang string")
    seen = context.summaries(docs, lambda prompts: [p[:60] for p in prompts], docs.lang)
    got = {r.doc_id: r.document_summary for r in seen.collect()}
    assert got["d"].startswith(context.LANGUAGE_NOTE) and got["e"] == "short"
    secs = spark.createDataFrame([("d", 0, "T", "body")], "doc_id string, section_index int, title string, content string")
    assert context.section_summaries(secs, lambda p: [x.upper() for x in p]).first().summary == "T\n\nBODY"


def test_images_are_compressed_to_the_limit():
    sizes = []

    def encode(image, quality, scale):
        sizes.append((quality, scale))
        return b"x" * int(len(image) * quality / 100 * scale * scale)

    assert len(compressed(b"x" * 1000, encode, 500)) <= 500 and sizes[-1] == (50, 1.0)
    assert compressed(b"abc", encode, 500) == b"abc" and len(compressed(b"x" * 10_000, encode, 500)) <= 500
