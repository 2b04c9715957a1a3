"""Queries of lines, sections, chunks and context."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.functions import sql
from corpusloom.operators import chunks, context, lines, sections
from corpusloom.session import cut, table
from corpusloom.sources import files

WINDOW_CHARS = 1500
#: White space as Python's str.split knows it, for RE2.
SPACES = r"[\x{09}-\x{0D}\x{1C}-\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"


def documents(spark, d):
    return table(spark, d, "documents").select("doc_id", "text")


def elements(spark, d):
    """Elements made of the parsed chunks: visual ones are figures, tables and images, short ones headers."""
    kind = F.when(F.coalesce("is_visual", F.lit(False)), F.element_at(F.array(F.lit("Figure"), F.lit("Table"), F.lit("Image")), (F.col("item_id") % 3 + 1).cast("int")))
    kind = kind.when(F.length("content") <= 60, "Header").otherwise("NarrativeText")
    pos = (F.coalesce("section_index", F.lit(0)).cast("bigint") * 1_000_000 + F.coalesce("line_start", F.lit(0))) * 10_000_000 + F.col("item_id")
    return table(spark, d, "parsed_chunks").select("doc_id", pos.alias("pos"), kind.alias("type"), "content", F.col("page_start").alias("page_number"))


def pages(spark, d):
    return context.page_texts(elements(spark, d)).where("content is not null")


def parsed_lines(spark, d):
    """Lines of the parsed chunks with section and visual flag, numbered through each document."""
    rows = table(spark, d, "parsed_chunks").where("content is not null").select(
        "doc_id", F.coalesce("section_index", F.lit(0)).alias("section_index"), F.coalesce("line_start", F.lit(0)).alias("first"), "item_id",
        F.coalesce("is_visual", F.lit(False)).alias("is_visual"), F.col("page_start").alias("page_number"), F.posexplode(F.split("content", "\n", -1)).alias("sub", "content"),
    )
    return lines.numbered(rows, "doc_id", ["section_index", "first", "item_id", "sub"], "line_no", 0).select("doc_id", "section_index", "line_no", "content", "page_number", "is_visual")


def lin_01(spark, d):
    rows = documents(spark, d).select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line")).where(F.length("line") > lines.MAX_LINE)
    return rows.select("doc_id", "pos", F.posexplode(lines.line_array(F.col("line"))).alias("sub", "content"))


def lin_02(spark, d):
    return lines.document_lines(documents(spark, d)).select("doc_id", "line_no", "content", "element_type", "is_visual")


def lin_03(spark, d):
    return lines.page_lines(pages(spark, d)).select("doc_id", "line_no", "content", "page_number")


def lin_04(spark, d):
    return lines.element_lines(elements(spark, d)).select("doc_id", "line_no", "content", "element_type", "page_number", "is_visual")


def lin_05(spark, d):
    names = F.broadcast(spark.createDataFrame(list(lines.ELEMENT_TYPES), "type string, is_visual boolean"))
    rows = elements(spark, d).join(names, "type").groupBy("is_visual").agg(F.count(F.lit(1)).alias("elements"))
    said = {v: lines.named([n for n, x in lines.ELEMENT_TYPES if x == v]) for v in (True, False)}
    return rows.withColumn("names", F.when(F.col("is_visual"), F.lit(said[True])).otherwise(F.lit(said[False])))


def _texts(spark, d):
    return lines.document_arrays(documents(spark, d))


def sec_01(spark, d):
    return sections.windows(_texts(spark, d), WINDOW_CHARS).select("doc_id", "window_no", "window_start", "window_end")


def sec_02(spark, d):
    texts = _texts(spark, d)
    return sections.window_texts(texts, sections.windows(texts, WINDOW_CHARS)).select("doc_id", "window_no", "window_text")


class _Flow:
    """The stages of sectioning over the documents; every document stays in its row."""

    def __init__(self, spark, d):
        self.proposed = sections.headed(sections.windowed(_texts(spark, d), WINDOW_CHARS))

    def consolidated(self):
        return sections.consolidated(self.proposed)

    def repaired(self):
        return sections.repaired_windows(self.consolidated())

    def merged(self):
        return sections.merged(self.repaired())

    def whole(self):
        return sections.repaired_documents(self.merged())

    def filled(self):
        return sections.filled(self.whole()).withColumn("content", F.array_join("lines", "\n")).drop("lines")


def _listed(plans):
    return plans.select("doc_id", F.posexplode("sections").alias("pos", "s")).select("doc_id", "pos", "s.title", "s.start")


def sec_03(spark, d):
    return sections.rows_of(_Flow(spark, d).proposed)


def sec_05(spark, d):
    return sections.rows_of(_Flow(spark, d).consolidated())


def sec_06(spark, d):
    return sections.rows_of(_Flow(spark, d).repaired())


def sec_07(spark, d):
    return sections.rows_of(_Flow(spark, d).repaired()).where(F.col("title").rlike(r"^Window \d+-\d+$")).select("doc_id", "window_no", "title")


def sec_08(spark, d):
    return _listed(_Flow(spark, d).merged())


def sec_09(spark, d):
    return _listed(_Flow(spark, d).whole())


def sec_10(spark, d):
    return _Flow(spark, d).filled()


def sec_11(spark, d):
    return sections.whole_sections(_texts(spark, d))


def sec_12(spark, d):
    return sections.sections_of(_texts(spark, d), min_length=400, window_chars=WINDOW_CHARS).groupBy("doc_id").agg(F.count(F.lit(1)).alias("sections"), F.sum(F.length("content")).cast("bigint").alias("characters"))


def chk_01(spark, d):
    return chunks.runs(parsed_lines(spark, d)).select("doc_id", "section_index", "line_no", "run")


def chk_02(spark, d):
    made = chunks.run_texts(parsed_lines(spark, d)).where(F.col("is_visual") | (F.length("content") < chunks.MIN_LENGTH))
    return made.select("doc_id", "section_index", "run", "line_start", "line_end", "content", "is_visual", F.col("pages")[0].alias("page_start"), F.element_at("pages", -1).alias("page_end"))


def chk_03(spark, d):
    return chunks.chunk_lines(parsed_lines(spark, d))


def chk_04(spark, d):
    return chunks.indexed(chunks.chunk_lines(parsed_lines(spark, d))).select("doc_id", "chunk_index", "line_start", "line_end")


def chk_05(spark, d):
    """The lines that hold characters 300 to 600 of every section's text."""
    w = "partition by doc_id, section_index order by line_no"
    spans = parsed_lines(spark, d).selectExpr("doc_id", "section_index", "line_no", f"cast(sum(length(content) + 1) over ({w}) as int) - length(content) - 1 as a", f"cast(sum(length(content) + 1) over ({w}) as int) - 1 as b")
    # only lines around the two characters can be among those asked for
    near = spans.where("b + 1 >= 300 and a <= 600").groupBy("doc_id", "section_index").agg(F.array_sort(F.collect_list(F.struct("line_no", "a", "b"))).alias("spans"))
    ends = spans.groupBy("doc_id", "section_index").agg(F.min("line_no").alias("low"), F.max("line_no").alias("high"))

    def run(parts):
        for part in parts:
            found = [chunks.lines_in_range(300, 600, [(x["line_no"], x["a"], x["b"]) for x in (s if s is not None else [])], a, b) for s, a, b in zip(part["spans"], part["low"], part["high"])]
            yield part[["doc_id", "section_index"]].assign(first_line=[a for a, _ in found], last_line=[b for _, b in found])

    return ends.join(near, ["doc_id", "section_index"], "left").mapInPandas(run, "doc_id string, section_index int, first_line int, last_line int")


def src_06(spark, d):
    return documents(spark, d).where("text is not null").select("doc_id", F.length("text").cast("bigint").alias("characters"))


def src_07(spark, d):
    counts = elements(spark, d).groupBy("doc_id").agg(F.max("page_number").alias("page_count"))
    return files.page_batches(counts).select("doc_id", "batch", "first", "last")


def src_09(spark, d):
    """The elements of each page as a reader's JSON answer, read back."""
    rows = elements(spark, d).where("page_number is not null and content is not null")
    answer = F.to_json(F.transform(F.array_sort(F.collect_list(F.struct("pos", "type", "content"))), lambda x: F.struct(x["type"].alias("type"), x["content"].alias("content"))))
    return files.elements(rows.groupBy("doc_id", "page_number").agg(answer.alias("answer"))).select("doc_id", "page_number", "pos", "type", "content")


def src_11(spark, d):
    return files.markdown(elements(spark, d))


def images(spark, d):
    """A listing of page images: every page of the parsed chunks has one to three files."""
    found = elements(spark, d).where("page_number is not null").select("doc_id", "page_number").distinct()
    kinds = F.explode(F.slice(F.array(F.lit("png"), F.lit("jpeg"), F.lit("jpg")), 1, (F.col("page_number") % 3 + 1).cast("int"))).alias("kind")
    return found.select("doc_id", "page_number", kinds).select("doc_id", F.concat(F.lit("/images/"), "doc_id", F.lit("/page_"), F.col("page_number").cast("string"), F.lit("."), "kind").alias("path"))


def src_13(spark, d):
    """The images of the pages of every parsed chunk, in order."""
    wanted = table(spark, d, "parsed_chunks").where("page_start <= page_end").select("item_id", "doc_id", F.explode(F.sequence("page_start", "page_end")).alias("page_number"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("page_number", "path"))), lambda x: x["path"])
    return wanted.join(files.image_files(images(spark, d)), ["doc_id", "page_number"]).groupBy("item_id").agg(F.array_join(ordered, ",").alias("paths"))


def src_14(spark, d):
    return files.image_files(images(spark, d))


def src_15(spark, d):
    """The stored page texts from page_start to page_end of every parsed chunk; missing pages are skipped."""
    wanted = table(spark, d, "parsed_chunks").where("page_start <= page_end").select("item_id", "doc_id", F.explode(F.sequence("page_start", "page_end")).alias("page_number"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("page_number", "content"))), lambda x: x["content"])
    return wanted.join(pages(spark, d), ["doc_id", "page_number"]).groupBy("item_id").agg(F.array_join(ordered, "\n").alias("content"))


def ctx_01(spark, d):
    text, kept = context.first_tokens(F.col("text"), 100)
    return documents(spark, d).where("text is not null").select("doc_id", text.alias("content"), kept.cast("bigint").alias("tokens"))


def ctx_02(spark, d):
    return table(spark, d, "kb_documents").select("doc_id", context.resolved_title(F.col("title"), F.lit(None).cast("string"), F.col("doc_id")).alias("title"))


def ctx_03(spark, d):
    from corpusloom.plugins import FirstWords

    rows = table(spark, d, "documents").where("text is not null").select("doc_id", "text", "lang")
    return context.summaries(rows, FirstWords().answer, F.col("lang")).select("doc_id", "document_summary")


def ctx_04(spark, d):
    from corpusloom.plugins import FirstWords

    return context.section_summaries(_Flow(spark, d).filled(), FirstWords().answer).select("doc_id", "section_index", "summary")


def udf_lines(spark, d):
    """The lines of the corpus by the SQL table function."""
    sql.register(spark)
    return spark.sql("select doc_id, l.line_no, l.content from {docs}, lateral text_lines(text, 200) l", docs=documents(spark, d).where("text is not null"))


def udf_pieces(spark, d):
    sql.register(spark)
    return spark.sql("select doc_id, p.piece, p.content from {docs}, lateral text_pieces(text, 800) p", docs=documents(spark, d).where("text is not null"))


def ctx_05(spark, d):
    a, b = context.notes(F.col("text"), F.col("lang"), 200)
    return table(spark, d, "documents").where("text is not null").select("doc_id", a.alias("language_note"), b.alias("truncation_note"))


def ctx_06(spark, d):
    """Parsed chunks with the title of their document and of their section (its first stored title)."""
    docs = table(spark, d, "kb_documents").groupBy("doc_id").agg(F.min("title").alias("document_title"), F.min("summary").alias("document_summary"))
    secs = table(spark, d, "chunk_store").groupBy("doc_id").agg(F.min("section_title").alias("title"), F.min("section_summary").alias("summary")).withColumn("section_index", F.lit(0))
    rows = context.attach_context(table(spark, d, "parsed_chunks").select("item_id", "doc_id", "section_index"), docs, secs)
    return rows.select("item_id", "document_title", "document_summary", "section_title", "section_summary")


def _header():
    return context.chunk_header(F.col("document_title"), F.col("document_summary"), F.col("section_title"), F.col("section_summary"))


def ctx_07(spark, d):
    return table(spark, d, "chunk_store").select("chunk_uid", _header().alias("header"))


def ctx_08(spark, d):
    return table(spark, d, "chunk_store").select("chunk_uid", context.document_header(F.col("document_title"), F.col("document_summary")).alias("header"))


def ctx_09(spark, d):
    return table(spark, d, "chunk_store").select("chunk_uid", context.text_to_embed(_header(), F.col("chunk_text")).alias("text_to_embed"))


TERMS = {"FIN": ["balance sheet", "cost base", "FIN"], "ENG": ["gearbox", "turbine", "battery pack"]}


def ctx_10(spark, d):
    return table(spark, d, "chunk_store").where("chunk_text is not null").select("chunk_uid", context.annotate_terms(F.col("chunk_text"), TERMS).alias("annotated"))


def ctx_11(spark, d):
    from corpusloom.plugins import HashedWords

    vector = context.embedded(F.col("chunk_text"), HashedWords().get_embeddings)
    return table(spark, d, "chunk_store").select("chunk_uid", F.round(F.aggregate(F.transform(vector, lambda v: v.cast("double") * v), F.lit(0.0), lambda a, x: a + x), 3).alias("squared_length"))


def ctx_12(spark, d):
    """item_id as chunk_index: an int as the SQL has it or, if an id of the table doesn't fit (where the SQL fails), a bigint."""
    items = table(spark, d, "parsed_chunks")
    kind = "int" if items.where(~F.col("item_id").between(-(2**31), 2**31 - 1)).isEmpty() else "bigint"
    rows = items.select("item_id", "doc_id", F.col("item_id").cast(kind).alias("chunk_index"), "content", "page_start", "page_end", "is_visual")
    rows = rows.withColumns({c: F.lit("") for c in ("document_title", "document_summary", "section_title", "section_summary")})
    return context.store_rows(rows).select("doc_id", "chunk_index", "chunk_text", F.col("chunk_length").cast("bigint").alias("chunk_length"), "chunk_page_start", "chunk_page_end", "is_visual")


def ctx_13(spark, d):
    return context.page_texts(elements(spark, d))


QUERIES = {
    "lin_01_split_long_line": lin_01, "lin_02_text_lines": lin_02, "lin_03_page_lines": lin_03, "lin_04_element_lines": lin_04, "lin_05_visual_types": lin_05,
    "sec_01_windows": sec_01, "sec_02_window_text": sec_02, "sec_03_boundaries": sec_03, "sec_05_consolidate": sec_05, "sec_06_window_repair": sec_06, "sec_07_fallback_titles": sec_07,
    "sec_08_merge": sec_08, "sec_09_document_repair": sec_09, "sec_10_fill_text": sec_10, "sec_11_whole_section": sec_11, "sec_12_sections": sec_12,
    "chk_01_runs": chk_01, "chk_02_single_chunks": chk_02, "chk_03_recursive_chunks": chk_03, "chk_04_chunk_lines": chk_04, "chk_05_lines_in_range": chk_05,
    "src_06_documents": src_06, "src_07_page_batches": src_07, "src_09_elements": src_09, "src_11_markdown": src_11, "src_13_page_images": src_13, "src_14_all_images": src_14, "src_15_page_range": src_15,
    "ctx_01_first_tokens": ctx_01, "ctx_02_titles": ctx_02, "ctx_03_document_summaries": ctx_03, "ctx_04_section_summaries": ctx_04, "udf_text_lines": udf_lines, "udf_text_pieces": udf_pieces, "ctx_05_prompt_notes": ctx_05, "ctx_06_attach": ctx_06, "ctx_07_chunk_header": ctx_07, "ctx_08_segment_header": ctx_08,
    "ctx_09_text_to_embed": ctx_09, "ctx_10_terms": ctx_10, "ctx_11_embeddings": ctx_11, "ctx_12_store_rows": ctx_12, "ctx_13_page_text": ctx_13,
}

# --- SQL --------------------------------------------------------------------

_PACK = f"""case when length(line) <= 200 then [line] else (
  select case when r.held is null then cast([] as varchar[]) else list_append(r.made, r.held) end from (
    select list_reduce(list_filter(regexp_split_to_array(line, '{SPACES}'), lambda w: w <> ''),
      lambda s, w: case when s.held is not null and length(w) + 1 > s.room
        then {{'made': list_append(s.made, s.held), 'held': w, 'room': 200 - length(w)}}
        else {{'made': s.made, 'held': case when s.held is null then w else s.held || ' ' || w end, 'room': s.room - length(w) - 1}} end,
      {{'made': cast([] as varchar[]), 'held': cast(null as varchar), 'room': cast(200 as bigint)}}) as r)) end"""
_LINES = f"""
raw as (select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as p from documents where text is not null),
packed as (select doc_id, p, {_PACK} as parts from raw),
flat as (select doc_id, p, unnest(parts) as content, generate_subscripts(parts, 1) as q from packed),
lines as (select doc_id, cast(row_number() over (partition by doc_id order by p, q) - 1 as integer) as line_no, content from flat)"""
_WINDOWS = f"""{_LINES},
texts as (select doc_id, list(content order by line_no) as ls, cast(count(*) as integer) as doc_len from lines group by doc_id),
folded as (select doc_id, doc_len, ls, list_reduce(list_transform(ls, lambda x: cast(length(x) as bigint)),
    lambda s, n: case when s.chars + n >= {0.9 * WINDOW_CHARS} then {{'chars': cast(0 as bigint), 'i': s.i + 1, 'ends': list_append(s.ends, s.i)}}
      else {{'chars': s.chars + n, 'i': s.i + 1, 'ends': s.ends}} end,
    {{'chars': cast(0 as bigint), 'i': cast(0 as integer), 'ends': cast([] as integer[])}}).ends as ends from texts),
closed as (select doc_id, doc_len, ls, case when coalesce(ends[-1], -1) < doc_len - 1 then list_append(ends, doc_len - 1) else ends end as ends from folded),
spans as (select doc_id, doc_len, ls, cast(n as integer) as window_no, ends[n + 1] as window_end, case when n = 0 then 0 else ends[n] + 1 end as window_start
  from (select *, unnest(range(len(ends))) as n from closed)),
wtext as (select doc_id, window_no, window_start, window_end, doc_len,
    array_to_string(list_transform(range(window_start, window_end + 1), lambda i: '[' || i || '] ' || ls[i + 1] || chr(10)), '') as window_text from spans)"""
_PROPOSED = f"""{_WINDOWS},
heads as (select doc_id, line_no as start, regexp_replace(content, '^#+[ \\t\\n\\r\\f]*', '') as title from lines
  where regexp_matches(content, '^#{{1,6}} [^ \\t\\n\\r\\f]') or (regexp_matches(content, '^[0-9]+(\\.[0-9]+)*\\.? \\p{{L}}') and length(content) <= 80 and not regexp_matches(content, '[.!?:;,][ \\t\\n\\r\\f]*$'))),
proposed as (select s.doc_id, s.window_no, cast(row_number() over (partition by s.doc_id, s.window_no order by h.start) - 1 as integer) as pos, h.title, h.start
  from spans s join heads h on h.doc_id = s.doc_id and h.start between s.window_start and s.window_end)"""
_CONSOLIDATED = f"""{_PROPOSED},
counted as (select p.*, count(*) over (partition by p.doc_id, p.window_no) as n, length(w.window_text) as chars, w.window_start from proposed p join wtext w using (doc_id, window_no)),
consolidated as (select doc_id, window_no, pos, case when n > 1 and chars / n < 500 then 'Consolidated Section' else title end as title,
    case when n > 1 and chars / n < 500 then window_start else start end as start
  from counted where not (n > 1 and chars / n < 500) or pos = 0)"""
_REPAIRED = f"""{_CONSOLIDATED},
o1 as (select c.*, s.window_start, s.window_end, s.doc_len, row_number() over (partition by c.doc_id, c.window_no, c.start order by pos) as rn from consolidated c join spans s using (doc_id, window_no)),
o2 as (select *, row_number() over (partition by doc_id, window_no order by start) - 1 as i from o1 where rn = 1 and start <= least(window_end, doc_len - 1)),
repaired as (
  select doc_id, window_no, cast(i as integer) as pos, title,
    cast(max(case when i = 0 then window_start else start end - i) over (partition by doc_id, window_no order by i rows unbounded preceding) + i as integer) as start from o2
  union all
  select doc_id, window_no, 0, 'Window ' || window_start || '-' || window_end, window_start from spans s
  where not exists (select 1 from o2 where o2.doc_id = s.doc_id and o2.window_no = s.window_no))"""
# the merge is followed window by window, as the rule is told
_MERGED = f"""{_REPAIRED},
sizes as (select doc_id, window_no, count(*) as n from repaired group by 1, 2),
nexts as (select *, lead(n) over (partition by doc_id order by window_no) as nn, max(window_no) over (partition by doc_id) as lastw from sizes),
walk as (
  select doc_id, window_no, n > 1 and coalesce(nn > 1 or window_no + 1 = lastw, false) and nn is not null as joins, false as joined from nexts where window_no = 0
  union all
  select x.doc_id, x.window_no, not w.joins and x.n > 1 and coalesce(x.nn > 1 or x.window_no + 1 = x.lastw, false) and x.nn is not null, w.joins
  from walk w join nexts x on x.doc_id = w.doc_id and x.window_no = w.window_no + 1),
merged as (
  select doc_id, cast(row_number() over (partition by doc_id order by window_no, pos) - 1 as integer) as pos, title, start from (
    select r.doc_id, r.window_no, r.pos, r.start, w.joined,
      case when w.joins and r.pos = s.n - 1 then r.title || ' / ' || lead(r.title) over (partition by r.doc_id order by r.window_no, r.pos) else r.title end as title
    from repaired r join walk w using (doc_id, window_no) join sizes s using (doc_id, window_no))
  where not (joined and pos = 0))"""
_WHOLE = f"""{_MERGED},
g1 as (select m.*, t.doc_len, row_number() over (partition by m.doc_id, m.start order by pos) as rn from merged m join texts t using (doc_id)),
g2 as (select *, row_number() over (partition by doc_id order by start) - 1 as i from g1 where rn = 1 and start <= doc_len - 1),
fixed as (
  select doc_id, cast(i as integer) as pos, title, cast(max(case when i = 0 then 0 else start end - i) over (partition by doc_id order by i rows unbounded preceding) + i as integer) as start from g2
  union all select doc_id, 0, 'Document', 0 from texts where doc_id not in (select doc_id from g2))"""
_FILLED = f"""{_WHOLE},
ends as (select f.doc_id, f.title, f.start, least(coalesce(lead(f.start) over (partition by f.doc_id order by f.start, f.pos) - 1, t.doc_len - 1), t.doc_len - 1) as "end", t.ls from fixed f join texts t using (doc_id)),
filled as (select doc_id, cast(row_number() over (partition by doc_id order by start) - 1 as integer) as section_index, title, start, "end", array_to_string(ls[start + 1 : "end" + 1], chr(10)) as content from ends where start <= "end")"""
_ELEMENTS = """
elements as (select doc_id, (cast(coalesce(section_index, 0) as bigint) * 1000000 + coalesce(line_start, 0)) * 10000000 + item_id as pos,
    case when coalesce(is_visual, false) then ['Figure', 'Table', 'Image'][item_id % 3 + 1] when length(content) <= 60 then 'Header' else 'NarrativeText' end as type,
    content, page_start as page_number from parsed_chunks)"""
_PAGES = f"""{_ELEMENTS},
pages as (select doc_id, page_number, string_agg(coalesce(content, ''), chr(10) order by pos) as content from elements
  where page_number is not null and doc_id in (select doc_id from elements group by 1 having arg_min(coalesce(page_number, -1), pos) >= 0) group by 1, 2)"""
_PARSED = """
plines as (select doc_id, section_index, cast(row_number() over (partition by doc_id order by section_index, l0, item_id, q) - 1 as integer) as line_no, content, page_number, is_visual
  from (select doc_id, coalesce(section_index, 0) as section_index, coalesce(line_start, 0) as l0, item_id, coalesce(is_visual, false) as is_visual, page_start as page_number,
      unnest(string_split(content, chr(10))) as content, generate_subscripts(string_split(content, chr(10)), 1) as q from parsed_chunks where content is not null)),
runs as (select *, cast(sum(case when is_visual or coalesce(prev, true) then 1 else 0 end) over (partition by doc_id, section_index order by line_no rows unbounded preceding) as integer) as run
  from (select *, lag(is_visual) over (partition by doc_id, section_index order by line_no) as prev from plines))"""
_STRIP = f"regexp_replace({{0}}, '^{SPACES}|{SPACES}$', '', 'g')".replace("{0}", "CONTENT")
#: The recursive splitter over source(id, text): a node is cut at the first separator it holds, long parts are nodes again, and
#: the parts between two long ones are packed; cut(id, piece, content) has the pieces in order.
_CUT = f"""
node as (
  select id, cast([] as bigint[]) as path, text, 0 as lv from source where text <> ''
  union all
  select id, list_append(path, i), piece, lvl + 1 from (select id, path, lvl, unnest(ps) as piece, generate_subscripts(ps, 1) as i from (select id, path, lvl, PIECES as ps from (select *, AT as lvl from node)))
  where length(piece) >= 800 and lvl < 3),
child as (select id, path, i, piece, length(piece) >= 800 as big from (select id, path, lvl, unnest(ps) as piece, generate_subscripts(ps, 1) as i from (select id, path, lvl, PIECES as ps from (select *, AT as lvl from node)))),
grp as (select *, sum(case when big then 1 else 0 end) over (partition by id, path order by i rows unbounded preceding) as g from child),
packs as (select id, list_append(path, min(i)) as place, list_reduce(list(piece order by i),
    lambda s, w: case when s.total + length(w) > 800 then {{'made': list_append(s.made, s.held), 'held': w, 'total': length(w)}} else {{'made': s.made, 'held': s.held || w, 'total': s.total + length(w)}} end,
    {{'made': cast([] as varchar[]), 'held': '', 'total': cast(0 as bigint)}}) as r from grp where not big group by id, path, g),
flatcut as (select id, place, {_STRIP.replace("CONTENT", "content")} as content, j from (select id, place, unnest(list_append(r.made, r.held)) as content, generate_subscripts(list_append(r.made, r.held), 1) as j from packs)),
cut as (select id, cast(row_number() over (partition by id order by place, j) - 1 as integer) as piece, content from flatcut where content <> '')""".replace(
    "PIECES", "list_filter(case lvl when 3 then regexp_extract_all(text, '(?s).') else list_transform(string_split(text, MARK), lambda x, n: case when n = 1 then x else MARK || x end) end, lambda x: x <> '')"
).replace("MARK", "(case lvl when 0 then chr(10) || chr(10) when 1 then chr(10) else ' ' end)").replace("AT as lvl", "case when lv <= 0 and contains(text, chr(10) || chr(10)) then 0 when lv <= 1 and contains(text, chr(10)) then 1 when lv <= 2 and contains(text, ' ') then 2 else 3 end as lvl")
#: Chunks of the parsed lines: short and visual runs as they are; longer ones cut, a short last piece joined to the one before, each with the lines that hold its characters.
_CHUNKS = f"""{_PARSED},
whole as (select doc_id, section_index, run, bool_or(is_visual) as is_visual, string_agg(content, chr(10) order by line_no) as content, min(line_no) as a, max(line_no) as b from runs group by 1, 2, 3),
short as (select * from whole where is_visual or length(content) < 1600),
source as (select {{'d': doc_id, 's': section_index, 'r': run}} as id, content || chr(10) as text from whole where not (is_visual or length(content) < 1600)),{_CUT},
sized as (select *, cast(sum(length(content) + 1) over (partition by id order by piece rows unbounded preceding) - length(content) - 1 as bigint) as c0, length(content) as n, max(piece) over (partition by id) as last from cut),
spans as (select l.doc_id, l.section_index, l.run, l.line_no, sum(length(l.content) + 1) over (partition by l.doc_id, l.section_index, l.run order by l.line_no rows unbounded preceding) - 1 - length(l.content) as x, length(l.content) as n
  from runs l join source s on s.id.d = l.doc_id and s.id.s = l.section_index and s.id.r = l.run),
placed as (select c.id, c.piece, c.content, c.n, c.last,
    coalesce(max(case when x <= c0 and c0 <= x + p.n + 1 then line_no end), min(case when c0 < x and c0 + c.n > x + p.n then line_no end), min(line_no)) as a,
    coalesce(max(case when (x <= c0 + c.n and c0 + c.n <= x + p.n + 1) or (c0 < x and c0 + c.n > x + p.n) then line_no end), max(line_no)) as b
  from sized c join spans p on p.doc_id = c.id.d and p.section_index = c.id.s and p.run = c.id.r group by all),
marked as (select *, last > 0 and bool_or(piece = last and n < 400) over (partition by id) as joins from placed),
joined as (select id, case when joins and piece = last then last - 1 else piece end as piece, string_agg(content, chr(10) order by piece) as content, arg_min(a, piece) as a, arg_max(b, piece) as b from marked group by 1, 2),
made as (select doc_id, section_index, run, cast(0 as integer) as piece, a, b, content, is_visual from short union all select id.d, id.s, id.r, cast(piece as integer), a, b, content, false from joined),
chunked as (select m.doc_id, m.section_index, m.run, m.piece, m.a as line_start, m.b as line_end, m.content, f.page_number as page_start, t.page_number as page_end, m.is_visual
  from made m join runs f on f.doc_id = m.doc_id and f.section_index = m.section_index and f.line_no = m.a join runs t on t.doc_id = m.doc_id and t.section_index = m.section_index and t.line_no = m.b)"""
_TRIM = r"regexp_replace({0}, '^[\s\x{{0B}}\x{{1C}}-\x{{1F}}\x{{85}}\x{{A0}}\x{{1680}}\x{{2000}}-\x{{200A}}\x{{2028}}\x{{2029}}\x{{202F}}\x{{205F}}\x{{3000}}]+|[\s\x{{0B}}\x{{1C}}-\x{{1F}}\x{{85}}\x{{A0}}\x{{1680}}\x{{2000}}-\x{{200A}}\x{{2028}}\x{{2029}}\x{{202F}}\x{{205F}}\x{{3000}}]+$', '', 'g')"
#: The corpus as a knowledge base cuts it: sections in windows of the default size, then chunks.
INGEST = f"""with recursive {_FILLED.replace(str(0.9 * WINDOW_CHARS), str(0.9 * sections.WINDOW_CHARS))},
source as (select {{'d': doc_id, 's': section_index}} as id, content || chr(10) as text from filled where length(content) >= 1600),{_CUT},
n as (select id, count(*) as k, arg_max(length(content), piece) as tail from cut group by 1),
per as (select id.d as doc_id, k - case when k > 1 and tail < 400 then 1 else 0 end as k from n union all select doc_id, 1 from filled where length(content) < 1600),
c as (select doc_id, sum(k) as k from per group by 1)
select cast(doc_id as varchar) as doc_id, cast(k as bigint) as chunks, cast(k - 1 as integer) as last, case when coalesce({_TRIM.format('title')}, '') <> '' then title else cast(doc_id as varchar) end as title from c join documents using (doc_id)"""
_TOKENS = r"regexp_extract_all({0}, '[ \t\n\r\f]*(?:[\p{{L}}\p{{N}}]+|[^ \t\n\r\f\p{{L}}\p{{N}}])')"
#: The first twelve words of the last paragraph of a prompt.
_FIRST_WORDS = f"array_to_string(list_filter(regexp_split_to_array(string_split(regexp_replace(prompt, '^{SPACES}|{SPACES}$', '', 'g'), chr(10) || chr(10))[-1], '{SPACES}'), lambda w: w <> '')[1:12], ' ')"
_DOC_HEAD = "case when coalesce(document_title, '') <> '' then 'Document context: the following excerpt is from a document titled ''' || document_title || '''. ' || coalesce(document_summary, '') else '' end"
_SEC_HEAD = "case when coalesce(section_title, '') <> '' then chr(10) || chr(10) || 'Section context: this excerpt is from the section titled ''' || section_title || '''. ' || coalesce(section_summary, '') else '' end"
_IMAGES = f"""{_ELEMENTS},
listing as (select doc_id, page_number, unnest(['png', 'jpeg', 'jpg'][1 : page_number % 3 + 1]) as kind from (select distinct doc_id, page_number from elements where page_number is not null)),
images as (select doc_id, page_number, '/images/' || doc_id || '/page_' || page_number || '.' || case max(case kind when 'jpg' then 3 when 'jpeg' then 2 else 1 end) when 3 then 'jpg' when 2 then 'jpeg' else 'png' end as path from listing group by 1, 2)"""


def _terms(text: str) -> str:
    for key, names in TERMS.items():
        for name in sorted({n for n in names if n != key}):
            text = f"replace({text}, '{name}', '{name} ({key})')"
        text = _TRIM.format(text)
    return text


SQL = {
    "lin_01_split_long_line": f"with {_LINES} select doc_id, cast(p - 1 as integer) as pos, cast(q - 1 as integer) as sub, content from flat where (doc_id, p) in (select doc_id, p from raw where length(line) > 200)",
    "lin_02_text_lines": f"with {_LINES} select doc_id, line_no, content, 'NarrativeText' as element_type, false as is_visual from lines",
    "udf_text_lines": f"with {_LINES} select doc_id, line_no, content from lines",
    "lin_03_page_lines": f"""with {_PAGES},
raw as (select doc_id, page_number, unnest(string_split(content, chr(10))) as line, generate_subscripts(string_split(content, chr(10)), 1) as p from pages),
packed as (select doc_id, page_number, p, {_PACK} as parts from raw),
flat as (select doc_id, page_number, p, unnest(parts) as content, generate_subscripts(parts, 1) as q from packed)
select doc_id, cast(row_number() over (partition by doc_id order by page_number, p, q) - 1 as integer) as line_no, content, page_number from flat""",
    "lin_04_element_lines": f"""with {_ELEMENTS},
kept as (select *, type in ('Figure', 'Image', 'Table', 'Equation') as v from elements where content is not null and type not in ('Header', 'Footer')),
raw as (select doc_id, pos, type, page_number, v, unnest(case when v then [content] else string_split(content, chr(10)) end) as line,
    generate_subscripts(case when v then [content] else string_split(content, chr(10)) end, 1) as p from kept),
packed as (select doc_id, pos, type, page_number, v, p, case when v then [line] else {_PACK} end as parts from raw),
flat as (select *, unnest(parts) as content, generate_subscripts(parts, 1) as q from packed)
select doc_id, cast(row_number() over (partition by doc_id order by pos, p, q) - 1 as integer) as line_no, content, type as element_type, page_number, v as is_visual from flat""",
    "lin_05_visual_types": f"""with {_ELEMENTS} select v as is_visual, count(*) as elements, case when v then 'Figure, Image, Table, and Equation' else 'NarrativeText, Header, Footnote, and Footer' end as names
from (select type in ('Figure', 'Image', 'Table', 'Equation') as v from elements) group by v""",
    "sec_01_windows": f"with {_WINDOWS} select doc_id, window_no, window_start, window_end from spans",
    "sec_02_window_text": f"with {_WINDOWS} select doc_id, window_no, window_text from wtext",
    "sec_03_boundaries": f"with {_PROPOSED} select doc_id, window_no, pos, title, start from proposed",
    "sec_05_consolidate": f"with {_CONSOLIDATED} select doc_id, window_no, pos, title, start from consolidated",
    "sec_06_window_repair": f"with {_REPAIRED} select doc_id, window_no, pos, title, start from repaired",
    "sec_07_fallback_titles": f"with {_CONSOLIDATED} select doc_id, window_no, 'Window ' || window_start || '-' || window_end as title from spans s where not exists (select 1 from consolidated c where c.doc_id = s.doc_id and c.window_no = s.window_no)",
    "sec_08_merge": f"with recursive {_MERGED} select doc_id, pos, title, start from merged",
    "sec_09_document_repair": f"with recursive {_WHOLE} select doc_id, pos, title, start from fixed",
    "sec_10_fill_text": f"""with recursive {_FILLED} select doc_id, section_index, title, start, "end", content from filled""",
    "sec_11_whole_section": f"""with {_WINDOWS} select doc_id, cast(0 as integer) as section_index, '' as title, cast(0 as integer) as start, doc_len - 1 as "end", array_to_string(ls, chr(10)) as content from texts""",
    "sec_12_sections": f"""with recursive {_FILLED}, short as (select doc_id, array_to_string(ls, chr(10)) as content from texts where length(array_to_string(ls, chr(10))) <= 400)
select doc_id, count(*) as sections, cast(sum(length(content)) as bigint) as characters from (
  select doc_id, content from filled where doc_id not in (select doc_id from short) union all select doc_id, content from short) group by doc_id""",
    "chk_01_runs": f"with {_PARSED} select doc_id, section_index, line_no, run from runs",
    "chk_02_single_chunks": f"""with {_PARSED} select * from (
select doc_id, section_index, run, min(line_no) as line_start, max(line_no) as line_end, string_agg(content, chr(10) order by line_no) as content, bool_or(is_visual) as is_visual,
  list(page_number order by line_no)[1] as page_start, list(page_number order by line_no)[-1] as page_end from runs group by 1, 2, 3) where is_visual or length(content) < 1600""",
    "chk_03_recursive_chunks": f"with recursive {_CHUNKS} select * from chunked",
    "chk_04_chunk_lines": f"with recursive {_CHUNKS} select doc_id, cast(row_number() over (partition by doc_id order by section_index, run, piece) - 1 as integer) as chunk_index, line_start, line_end from chunked",
    "udf_text_pieces": f"with recursive source as (select doc_id as id, text from documents where text is not null),{_CUT} select id as doc_id, piece, content from cut",
    "chk_05_lines_in_range": f"""with {_PARSED},
s as (select doc_id, section_index, line_no, sum(length(content) + 1) over (partition by doc_id, section_index order by line_no rows unbounded preceding) - 1 as b, length(content) as n from plines),
t as (select *, b - n as a from s)
select doc_id, section_index,
  coalesce(max(case when a <= 300 and 300 <= b + 1 then line_no end), min(case when a > 300 and b < 600 then line_no end), min(line_no)) as first_line,
  coalesce(max(case when (a <= 600 and 600 <= b + 1) or (a > 300 and b < 600) then line_no end), max(line_no)) as last_line
from t group by 1, 2""",
    "src_06_documents": "select doc_id, length(text) as characters from documents where text is not null",
    "src_07_page_batches": f"""with {_ELEMENTS}, c as (select doc_id, max(page_number) as n from elements group by 1)
select doc_id, cast(b as integer) as batch, cast(b * 10 + 1 as integer) as first, cast(least(b * 10 + 10, n) as integer) as last from (select doc_id, n, unnest(range((n + 9) // 10)) as b from c where n > 0)""",
    "src_09_elements": f"""with {_ELEMENTS} select doc_id, page_number, cast(page_number as bigint) * 1000000 + row_number() over (partition by doc_id, page_number order by pos) - 1 as pos, type, content
from elements where page_number is not null and content is not null""",
    "src_11_markdown": f"with {_ELEMENTS} select doc_id, string_agg(coalesce(content, '') || chr(10) || chr(10), '' order by pos) as text from elements group by 1",
    "src_13_page_images": f"""with {_IMAGES}, w as (select item_id, doc_id, unnest(range(page_start, page_end + 1)) as page_number from parsed_chunks where page_start <= page_end)
select item_id, string_agg(path, ',' order by page_number) as paths from w join images using (doc_id, page_number) group by 1""",
    "src_14_all_images": f"with {_IMAGES} select doc_id, page_number, path from images",
    "src_15_page_range": f"""with {_PAGES}, w as (select item_id, doc_id, unnest(range(page_start, page_end + 1)) as page_number from parsed_chunks where page_start <= page_end)
select item_id, string_agg(content, chr(10) order by page_number) as content from w join pages using (doc_id, page_number) group by 1""",
    "ctx_01_first_tokens": f"select doc_id, case when len(t) <= 100 then text else array_to_string(t[1:100], '') end as content, cast(least(len(t), 100) as bigint) as tokens from (select doc_id, text, {_TOKENS.format('text')} as t from documents where text is not null)",
    "ctx_02_titles": f"select doc_id, case when coalesce({_TRIM.format('title')}, '') <> '' then title else doc_id end as title from kb_documents",
    "ctx_03_document_summaries": f"""with t as (select doc_id, lang, text, {_TOKENS.format('text')} as t from documents where text is not null),
p as (select doc_id, concat_ws(chr(10) || chr(10), case when coalesce(lang, 'en') <> 'en' then 'Answer in the language of the document.' end,
  case when len(t) >= 8000 then 'The text above is only the first 6000 words of the document.' end, case when len(t) <= 8000 then text else array_to_string(t[1:8000], '') end) as prompt from t)
select doc_id, {_FIRST_WORDS} as document_summary from p""",
    "ctx_04_section_summaries": f"with recursive {_FILLED}, p as (select doc_id, section_index, title || chr(10) || chr(10) || content as prompt from filled) select doc_id, section_index, {_FIRST_WORDS} as summary from p",
    "ctx_05_prompt_notes": f"""select doc_id, case when coalesce(lang, 'en') <> 'en' then 'Answer in the language of the document.' else '' end as language_note,
case when len({_TOKENS.format('text')}) >= 200 then 'The text above is only the first 150 words of the document.' else '' end as truncation_note from documents where text is not null""",
    "ctx_06_attach": """with d as (select doc_id, min(title) as document_title, min(summary) as document_summary from kb_documents group by 1),
s as (select doc_id, min(section_title) as section_title, min(section_summary) as section_summary from chunk_store group by 1)
select item_id, document_title, document_summary, section_title, section_summary from parsed_chunks p left join d using (doc_id) left join s on s.doc_id = p.doc_id and p.section_index = 0""",
    "ctx_07_chunk_header": f"select chunk_uid, {_DOC_HEAD} || {_SEC_HEAD} as header from chunk_store",
    "ctx_08_segment_header": f"select chunk_uid, {_DOC_HEAD} as header from chunk_store",
    "ctx_09_text_to_embed": f"select chunk_uid, {_DOC_HEAD} || {_SEC_HEAD} || chr(10) || chr(10) || coalesce(chunk_text, '') as text_to_embed from chunk_store",
    "ctx_10_terms": f"select chunk_uid, {_terms('chunk_text')} as annotated from chunk_store where chunk_text is not null",
    "ctx_12_store_rows": "select doc_id, cast(item_id as integer) as chunk_index, content as chunk_text, length(coalesce(content, '')) as chunk_length, page_start as chunk_page_start, page_end as chunk_page_end, coalesce(is_visual, false) as is_visual from parsed_chunks",
    "ctx_13_page_text": f"with {_PAGES} select doc_id, page_number, content from pages",
}
