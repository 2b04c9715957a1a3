from __future__ import annotations

import io
import json
import logging
import sys
import zipfile

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from corpusloom.catalog import KnowledgeBase
from corpusloom.observe import counted
from corpusloom.plugins import Embedding, HashedWords, LanguageModel, NoReranker, Optional_, PageReader, PageRenderer, Reranker, WordReranker, structured, unfinished_json
from corpusloom.sources import files
from corpusloom.sources.lake import Lake
from corpusloom.streaming import ingest
from corpusloom.turns import Chat, asked_queries


cloudpickle.register_pickle_by_value(sys.modules[__name__])  # the workers don't have this file


def docx(text):
    out = io.BytesIO()
    body = "".join(f"<w:p><w:r><w:t>{p}</w:t></w:r></w:p>" for p in text.split("\n"))
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body>{body}</w:body></w:document>')
    return out.getvalue()


class Pages(PageRenderer):
    def images(self, content, dpi):
        return [b"i%d" % i for i in range(content.count(b"|") + 1)]

    def texts(self, content):
        if b"broken" in content:
            raise ValueError("broken")
        return content.decode().split("|")


def test_directory(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.txt").write_text("plain é", encoding="utf-8")
    (tmp_path / "sub" / "b.md").write_bytes("﻿# head".encode())
    (tmp_path / "c.docx").write_bytes(docx("one\ntwo"))
    (tmp_path / "d.pdf").write_bytes(b"p1|p2")
    (tmp_path / "e.pdf").write_bytes(b"broken")
    (tmp_path / "f.PDF").write_bytes(b"x")
    (tmp_path / "g.docx").write_bytes(b"no zip")
    got = {r.doc_id: r for r in files.read_directory(spark, str(tmp_path), Pages()).collect()}
    assert {k: v.text for k, v in got.items() if v.text} == {"a.txt": "plain é", "sub_b.md": "# head", "c.docx": "one\ntwo", "d.pdf": "p1p2"}
    assert got["d.pdf"].pages == ["p1", "p2"] and "unsupported" in got["f.PDF"].error and got["g.docx"].error and got["e.pdf"].error
    assert files.read_file(spark, str(tmp_path / "a.txt")).first().doc_id == "a.txt"
    assert files.read_texts(spark, str(tmp_path / "a.txt")).first() == ("a.txt", "plain é")
    raw = spark.createDataFrame([("d", b"p1|p2|p3"), ("e", b"broken")], "doc_id string, content binary")
    assert {r.doc_id: r.page_count for r in files.page_counts(raw, Pages()).collect()} == {"d": 3, "e": None}
    assert [(r.page_number, bytes(r.image)) for r in files.page_images(raw.where("doc_id = 'd'"), Pages()).collect()] == [(1, b"i0"), (2, b"i1"), (3, b"i2")]


def test_page_reader_tries_again_and_falls_back(spark):
    class Never(PageReader):
        def read(self, image, instructions):
            raise RuntimeError("429")

    class Once(PageReader):
        def read(self, image, instructions):
            return json.dumps([{"type": "Table", "content": image.decode()}, {"type": "Footer", "content": None}])

    images = spark.createDataFrame([("d", 2, b"two"), ("d", 1, b"one")], "doc_id string, page_number int, image binary")
    found = files.elements(files.page_elements(images, Never(), Once())).orderBy("pos").collect()
    assert [(r.page_number, r.type, r.content) for r in found] == [(1, "Table", "one"), (1, "Footer", None), (2, "Table", "two"), (2, "Footer", None)]
    failed = files.elements(files.page_elements(images, Never(), attempts=2)).collect()
    assert {r.content for r in failed} == {files.FAILED_PAGE}
    assert files.markdown(files.elements(files.page_elements(images, Once()))).first().text == "one\n\n\n\ntwo\n\n\n\n"
    counts = spark.createDataFrame([("d", 25), ("e", 0)], "doc_id string, page_count int")
    assert [(r.first, r.last) for r in files.page_batches(counts).orderBy("batch").collect()] == [(1, 10), (11, 20), (21, 25)]
    listing = spark.createDataFrame([("d", f"/x/page_{p}") for p in ("1.png", "1.jpg", "2.jpeg", "10.png", "3.gif", "x.jpg")], "doc_id string, path string")
    assert [(r.page_number, r.path) for r in files.image_files(listing).orderBy("page_number").collect()] == [(1, "/x/page_1.jpg"), (2, "/x/page_2.jpeg"), (10, "/x/page_10.png")]


def test_lake(spark, tmp_path):
    lake = Lake(spark, str(tmp_path / "lake"))
    assert lake.load_json("none.json") is None and lake.read("t") is None and not lake.delete("t")
    lake.save_json("c.json", {"a": "é"})
    assert lake.load_json("c.json") == {"a": "é"}
    (tmp_path / "lake" / "bad.json").write_text("{")
    assert lake.load_json("bad.json") is None
    lake.append("t", spark.createDataFrame([(1, "a")], "id int, k string"))
    lake.append("t", spark.createDataFrame([(2, "b", 1.5)], "id int, k string, extra double"))
    assert sorted((r.id, r.extra) for r in lake.read("t").collect()) == [(1, None), (2, 1.5)]
    for _ in range(3):
        lake.replace("t", lake.read("t").where("id > 1"))
    assert [r.id for r in lake.read("t").collect()] == [2] and len([n for n in lake.names("t") if n.startswith("v")]) == 2


def test_commits_hold_wholly_or_not_at_all(spark, tmp_path):
    lake, other = Lake(spark, str(tmp_path / "lake")), Lake(spark, str(tmp_path / "lake"))
    rows = lambda *ids: spark.createDataFrame([(i, "k") for i in ids], "id int, k string")
    ids = lambda t: sorted(r.id for r in lake.read(t).collect())
    lake.commit(append={"a": lake.write("a", rows(1)), "b": lake.write("b", rows(1))})
    lake.write("a", rows(9))  # never committed
    assert ids("a") == [1] == ids("b")
    # a slower writer adds to what a faster one has committed, but doesn't replace it
    base, _ = lake.state()
    slow = lake.write("a", rows(2))
    other.append("a", rows(3))
    lake.commit(append={"a": slow}, base=base)
    assert ids("a") == [1, 2, 3]
    with pytest.raises(RuntimeError):
        lake.commit(replace={"a": lake.write("a", rows(4))}, base=base)
    lake.commit(replace={"b": lake.write("b", rows(5))}, base=base)  # the other table has not changed
    assert ids("b") == [5]
    # a writer was lost in the middle of its commit
    (tmp_path / "lake" / "_commits" / "0000000099.json").write_text('{"a": [')
    assert ids("a") == [1, 2, 3]
    other.append("a", rows(6))
    assert ids("a") == [1, 2, 3, 6] and lake.state()[0] == 100
    lake.replace("p", rows(1, 2), ["k"])
    lake.append("p", rows(3), ["k"])
    assert ids("p") == [1, 2, 3]


def test_a_load_that_fails_half_way_can_be_repeated(spark, tmp_path, monkeypatch):
    kb = KnowledgeBase(spark, str(tmp_path / "kbs"), "kb")
    rows = spark.createDataFrame(DOCS, "doc_id string, text string")
    whole = Lake.write

    def failing(self, table, rows, partition_by=None):
        if table == "vectors":
            raise OSError("disk full")
        return whole(self, table, rows, partition_by)

    monkeypatch.setattr(Lake, "write", failing)
    with pytest.raises(OSError):
        kb.add_documents(rows)
    assert kb.chunks is None and kb.vectors is None
    monkeypatch.setattr(Lake, "write", whole)
    assert kb.add_documents(rows).collect() == []
    assert kb.chunks.count() == kb.vectors.count() > 0 and {r.doc_id for r in kb.chunks.collect()} == {"apples", "cars"}


def test_plugins():
    class Mine(Embedding):
        def __init__(self, dimension=3):
            super().__init__(dimension=dimension)
            self.dimension = dimension

        def get_embeddings(self, texts, input_type=None):
            return [[1.0] * self.dimension for _ in texts]

    again = Embedding.from_dict(Mine(dimension=5).to_dict())
    assert isinstance(again, Mine) and again.dimension == 5 and "Mine" not in Reranker.family
    with pytest.raises(ValueError):
        Reranker.from_dict({"subclass_name": "Unknown"})
    with pytest.raises(ImportError, match="needs the package"):
        Optional_("no_such_module_here", "this feature").anything
    a, b = HashedWords(32).get_embeddings(["the same text", "the same text"])
    assert a == b and len(a) == 32 and abs(sum(x * x for x in a) - 1) < 1e-5


DOCS = [
    ("apples", "# Apples\n" + "Apples grow on trees in the orchard and are picked in autumn. " * 12 + "\n# Pears\n" + "Pears are sweet and soft when they are ripe. " * 12),
    ("cars", "# Engines\n" + "The engine of a car burns fuel and drives the wheels. " * 40),
]


def test_knowledge_base(spark, tmp_path, caplog):
    root = str(tmp_path / "kbs")
    kb = KnowledgeBase(spark, root, "kb", title="Fruit", reranker=NoReranker(ignore_absolute_relevance=True))
    assert kb.query(["apples"]).collect() == []
    bad = [("no/slash", "x"), ("empty", None)]
    refused = kb.add_documents(spark.createDataFrame(DOCS + bad, "doc_id string, text string"))
    assert {(r.doc_id, r.reason) for r in refused.collect()} == {("no/slash", "invalid id"), ("empty", "no text")}
    assert {r.doc_id for r in kb.chunks.collect()} == {"apples", "cars"} and kb.chunks.count() == kb.vectors.count()
    again = kb.add_documents(spark.createDataFrame(DOCS[:1], "doc_id string, text string"))
    assert [r.reason for r in again.collect()] == ["exists"] and kb.chunks.where("doc_id = 'apples'").count() == 2
    found = kb.query(["sweet ripe pears"], {"minimum_value": 0.0}).collect()
    assert found and found[0].doc_id in ("apples", "cars") and "Document context" in found[0].content
    only = kb.query(["engine"], {"minimum_value": 0.0}, {"field": "doc_id", "operator": "equals", "value": "cars"}).collect()
    assert {r.doc_id for r in only} == {"cars"} and only[0].segment_page_start is None
    with pytest.raises(ValueError):
        kb.query(["x"], return_mode="video")
    with pytest.raises(ValueError):
        KnowledgeBase(spark, root, "kb", exists_ok=False)
    with pytest.raises(ValueError):
        KnowledgeBase(spark, root, "kb", embedding=HashedWords(16))
    with caplog.at_level(logging.WARNING):
        loaded = KnowledgeBase(spark, root, "kb", reranker=WordReranker())
    assert "overridden" in caplog.text and loaded.info["title"] == "Fruit"
    assert loaded.query(["pears ripe"], {"minimum_value": 0.0}).first().doc_id == "apples"
    kb.delete_documents(["cars"])
    assert {r.doc_id for r in kb.chunks.collect()} == {"apples"} == {r.doc_id for r in kb.vectors.collect()}
    kb.delete()
    assert kb.chunks is None


class Echo(LanguageModel):
    def answer(self, prompts):
        return [json.dumps({"response": "word " * 45 + "end", "citations": [{"source_index": 0, "page_number": None, "cited_text": "x"}, {"source_index": 99}]}) for _ in prompts]


class Down(LanguageModel):
    def answer(self, prompts):
        raise RuntimeError("down")


def test_chat(spark, tmp_path):
    kb = KnowledgeBase(spark, str(tmp_path / "kbs"), "kb", reranker=NoReranker(ignore_absolute_relevance=True))
    kb.add_documents(spark.createDataFrame(DOCS, "doc_id string, text string"))
    chat = Chat(spark, {"kb": kb}, Echo())
    thread = chat.new_thread(kb_ids=["kb"], rse_params='{"minimum_value": 0.0}', model=None)
    assert thread["model"] == "gpt-4o-mini" and thread["max_chat_history_tokens"] == 8000
    states = list(chat.stream(thread, "apples in autumn"))
    assert [s["model_response_status"] for s in states] == ["pending", "streaming", "streaming", "finished"]
    cited = json.loads(states[-1]["citations"])
    assert len(cited) == 1 and cited[0]["kb_id"] == "kb" and json.loads(states[-1]["search_queries"]) == [{"query": "apples in autumn", "kb_id": "kb"}]
    prompt, segments, _ = chat.prepare(thread, "and pears?", chat.rows(states))
    assert "user: apples in autumn" in prompt and "<source_index: 0>" in prompt and segments
    assert Chat(spark, {"kb": kb}, Down()).respond(thread, "apples")["model_response_status"] == "failed"
    gone = list(chat.stream(thread | {"kb_ids": ["gone"]}, "x"))
    assert [s["model_response_status"] for s in gone] == ["pending", "failed"] and "gone" in gone[-1]["model_response"]
    with pytest.raises(ValueError):
        list(chat.stream(thread, "x", return_mode="video"))
    with pytest.raises(ValueError):
        chat.new_thread(colour="red")


class Typing(LanguageModel):
    serves = ("typing-", "t")

    def answer(self, prompts):
        return ["[]" for _ in prompts]

    def partials(self, messages, **options):
        whole = json.dumps({"response": 'He said "apples", then left.', "citations": [{"source_index": 0, "cited_text": "x"}]})
        for i in range(4, len(whole), 7):
            yield whole[:i]
        yield whole


def test_chat_stores_states_as_they_come(spark, tmp_path):
    kb = KnowledgeBase(spark, str(tmp_path / "kbs"), "kb", reranker=NoReranker(ignore_absolute_relevance=True))
    kb.add_documents(spark.createDataFrame(DOCS, "doc_id string, text string"))
    lake = Lake(spark, str(tmp_path / "chat"))
    chat = Chat(spark, {"kb": kb}, Typing(), lake=lake)
    thread = chat.new_thread(kb_ids=["kb"], rse_params='{"minimum_value": 0.0}')
    seen = []
    for state in chat.stream(thread, "apples"):
        seen.append(state)
        assert lake.read("interactions").count() == len(seen)
    texts = [s["model_response"] for s in seen if s["model_response_status"] == "streaming"]
    assert len(texts) > 2 and all(b.startswith(a) for a, b in zip(texts, texts[1:])) and seen[-1]["model_response"] == 'He said "apples", then left.'
    assert json.loads(seen[-1]["citations"])[0]["kb_id"] == "kb"
    prompt, _, _ = chat.prepare(thread, "and pears?")
    assert "user: apples" in prompt and 'assistant: He said "apples", then left.' in prompt


def test_pages_stand_in_the_context(spark, tmp_path):
    kb = KnowledgeBase(spark, str(tmp_path / "kbs"), "kb")
    kb.add_pages(spark.createDataFrame([("d", 1, "first page"), ("d", 2, "second page"), ("e", 1, "other")], "doc_id string, page_number int, content string"))
    segments = [{"kb_id": "kb", "source_index": 0, "doc_id": "d", "content": "c0", "segment_page_start": 1, "segment_page_end": 2}, {"kb_id": "kb", "source_index": 1, "doc_id": "f", "content": "c1", "segment_page_start": None, "segment_page_end": None}]
    text = Chat(spark, {"kb": kb}, Typing())._context(segments)
    assert "<page_1>\nfirst page\n</page_1>\n<page_2>\nsecond page" in text and "c0" not in text and "<source_index: 1>\nc1" in text and "other" not in text


def test_structured_answers():
    class Late(LanguageModel):
        serves = ("late",)
        asked: list = []

        def answer(self, prompts):
            self.asked.append(prompts[0])
            return ["no", '{"title": 3}', 'Here: {"title": "T", "parts": [{"n": 1}], "note": null} end'][len(self.asked) - 1 : len(self.asked)]

    kind = {"title": str, "parts": [{"n": int}], "note": (str, None)}
    assert structured(Late(), [{"role": "user", "content": "q"}], kind)["title"] == "T"
    assert "no JSON object" in Late.asked[1] and "title, parts" in Late.asked[2]
    Late.asked.clear()
    with pytest.raises(ValueError):
        structured(Late(), [{"role": "user", "content": "q"}], kind, attempts=2)
    with pytest.raises(ValueError):
        Late().chat([{"role": "user", "content": "q"}], images=(b"x",))
    assert isinstance(LanguageModel.serving("typing-large"), Typing) and isinstance(LanguageModel.serving("late-1"), Late)
    with pytest.raises(ValueError):
        LanguageModel.serving("nobody")
    whole = '{"a": "x\\"y", "b": [1, {"c": "z"}], "d": 5}'
    assert unfinished_json(whole) == json.loads(whole) and unfinished_json("no") == {} and unfinished_json('{"a": "x\\') == {"a": "x"}
    assert unfinished_json('{"a": "x", "b": [1, {"c": "z') == {"a": "x", "b": [1, {"c": "z"}]} and unfinished_json('{"a": "x", "b') == {"a": "x"}


def test_auto_query_fallback():
    class Made(LanguageModel):
        def answer(self, prompts):
            return [json.dumps([{"query": "q1", "kb_id": "a"}, {"query": "q2", "kb_id": "zzz"}])]

    bases = [{"kb_id": "a"}, {"kb_id": "b"}]
    messages = [{"role": "user", "content": "hi"}]
    want = [{"query": "q1", "kb_id": "a"}, {"query": "q2", "kb_id": "a"}, {"query": "q2", "kb_id": "b"}]
    assert asked_queries(Made(), None, messages, bases) == want == asked_queries(Down(), Made(), messages, bases)
    assert asked_queries(Down(), None, messages, bases) == []


def test_streamed_documents_are_added_once(spark, tmp_path):
    kb = KnowledgeBase(spark, str(tmp_path / "kbs"), "kb")
    rows = spark.createDataFrame(DOCS, "doc_id string, text string")
    rows.write.parquet(str(tmp_path / "in"))
    stream = ingest.read_tables(spark, str(tmp_path / "in"), "doc_id string, text string")
    ingest.load_documents(stream, kb, str(tmp_path / "c1")).awaitTermination()
    n = kb.chunks.count()
    ingest.load_documents(stream, kb, str(tmp_path / "c2")).awaitTermination()
    assert kb.chunks.count() == n > 0


def test_observation(spark):
    rows, seen = counted(spark.range(7), "rows_seen")
    assert rows.where(F.col("id") < 3).count() == 3 and seen.get["rows"] == 7
