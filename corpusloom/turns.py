"""A turn of a chat: queries, search, context, answer with citations, stored states."""

from __future__ import annotations

import json
import logging
import uuid
from collections.abc import Iterator
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.catalog import KnowledgeBase
from corpusloom.observe import step
from corpusloom.operators import chat
from corpusloom.operators.answers import RETURN_MODES
from corpusloom.plugins import LanguageModel, structured, unfinished_json
from corpusloom.sources.lake import Lake

log = logging.getLogger("corpusloom.chat")
STATE = "thread_id string, message_id string, user_input string, user_input_timestamp string, model_response string, model_response_timestamp string, model_response_status string, relevant_segments string, search_queries string, citations string, received_at timestamp"


def _now() -> datetime:
    return datetime.now(timezone.utc)


def asked_queries(model: LanguageModel | None, fallback: LanguageModel | None, messages: list[dict], bases: list[dict], limit: int = chat.MAX_QUERIES) -> list[dict]:
    """The queries a model makes of a conversation, as JSON [{"query": …, "kb_id": …}]; the fallback is asked if it fails, and if that fails too there are none.

    Without a model the user's input itself is the query, for every base.
    """
    if model is None:
        found = [{"query": messages[-1]["content"], "kb_id": b["kb_id"]} for b in bases]
    else:
        prompt = json.dumps({"messages": messages, "knowledge_bases": bases, "max_queries": limit}, ensure_ascii=False)
        found = []
        for m in (model, fallback):
            if m is None:
                continue
            try:
                raw = m.answer([prompt])[0]
                listed = json.loads(raw) if raw.lstrip().startswith("[") else structured(m, [{"role": "user", "content": prompt}], {"queries": [{"query": str}]})["queries"]
                found = [{"query": str(q["query"]), "kb_id": q.get("kb_id")} for q in listed]
                break
            except Exception:  # noqa: BLE001 - any failure of a provider leads to the next one
                log.warning("no queries from %s", type(m).__name__)
    known = [b["kb_id"] for b in bases]
    out = []
    for q in found[:limit]:
        out += [q] if q["kb_id"] in known else [{"query": q["query"], "kb_id": k} for k in known]
    return out[:limit]


class Chat:
    """Threads and their exchanges over a set of knowledge bases.

    One turn concerns one thread and a handful of segments, which is all that is
    brought to the driver.  With a lake, every state of an exchange is added to
    its table `interactions` as it comes, and the history is read from there.
    """

    def __init__(self, spark: SparkSession, bases: dict[str, KnowledgeBase], model: LanguageModel, query_model: LanguageModel | None = None, query_fallback: LanguageModel | None = None, lake: Lake | None = None):
        self.spark, self.bases, self.model, self.query_model, self.query_fallback, self.lake = spark, bases, model, query_model, query_fallback, lake

    def new_thread(self, **parameters) -> dict:
        unknown = set(parameters) - set(chat.DEFAULTS) - {"kb_ids", "supp_id"}
        if unknown:
            raise ValueError(f"unknown parameters: {', '.join(sorted(unknown))}")
        given = {k: v for k, v in parameters.items() if v is not None}
        return {"thread_id": str(uuid.uuid4()), "supp_id": "", "kb_ids": []} | chat.DEFAULTS | given

    def missing(self, thread: dict) -> list[str]:
        return [k for k in thread["kb_ids"] if k not in self.bases]

    def _history(self, thread: dict, interactions: DataFrame | None) -> list[dict]:
        if interactions is None and self.lake is not None:
            interactions = self.lake.read("interactions")
        if interactions is None:
            return []
        own = chat.current_interactions(interactions.where(F.col("thread_id") == thread["thread_id"]))
        kept = chat.trimmed(chat.messages(own), F.lit(thread["max_chat_history_tokens"])).orderBy("seq")
        return [{"role": r.role, "content": r.content} for r in kept.select("role", "content").collect()]

    def _search(self, thread: dict, queries: list[dict], metadata_filter: dict | None, return_mode: str) -> list[dict]:
        found: list[dict] = []
        for kb_id in dict.fromkeys(q["kb_id"] for q in queries):
            texts = [q["query"] for q in queries if q["kb_id"] == kb_id]
            rows = self.bases[kb_id].query(texts, json.loads(thread["rse_params"] or "{}"), metadata_filter, return_mode).collect()
            found += [r.asDict() | {"kb_id": kb_id} for r in rows]
        for i, row in enumerate(found):
            row["source_index"] = i
        return found

    def _context(self, segments: list[dict]) -> str:
        """The sources in their tags: their pages where the base holds them, else their content (see operators.chat)."""
        if not segments:
            return ""
        kind = "message_id string, kb_pos int, source_index int, doc_id string, content string, segment_page_start int, segment_page_end int"
        parts = []
        for pos, kb_id in enumerate(dict.fromkeys(s["kb_id"] for s in segments)):
            rows = [("", pos, s["source_index"], s["doc_id"], s["content"], s["segment_page_start"], s["segment_page_end"]) for s in segments if s["kb_id"] == kb_id]
            pages = self.bases[kb_id].pages
            if pages is None:
                pages = self.spark.createDataFrame([], "doc_id string, page_number int, content string")
            wanted = pages.where(F.col("doc_id").isin([r[3] for r in rows]))
            parts.append(chat.source_texts(self.spark.createDataFrame(rows, kind), wanted))
        every = parts[0]
        for part in parts[1:]:
            every = every.unionByName(part)
        return chat.contexts(every).first().context

    def prepare(self, thread: dict, user_input: str, interactions: DataFrame | None = None, metadata_filter: dict | None = None, return_mode: str = "text") -> tuple[str, list[dict], list[dict]]:
        """(prompt, segments, queries) of a turn."""
        if return_mode not in RETURN_MODES:
            raise ValueError(f"return_mode must be one of {', '.join(RETURN_MODES)}")
        if missing := self.missing(thread):
            raise ValueError(f"missing knowledge bases: {', '.join(missing)}")
        messages = [*self._history(thread, interactions), {"role": "user", "content": user_input}]
        bases = [{"kb_id": k} | {x: self.bases[k].info[x] for x in ("title", "description")} for k in thread["kb_ids"]]
        queries = asked_queries(self.query_model, self.query_fallback, messages, bases) if bases else []
        segments = self._search(thread, queries, metadata_filter, return_mode)
        context = self._context(segments)
        prompt = "\n\n".join(x for x in (thread["system_message"], chat.LENGTH_NOTES.get(thread["target_output_length"], ""), context, *(f"{m['role']}: {m['content']}" for m in messages)) if x)
        return prompt, segments, queries

    def _state(self, thread: dict, message_id: str, user_input: str, asked_at: datetime, status: str, response: str | None, segments: list[dict], queries: list[dict], citations: list[dict]) -> dict:
        return {
            "thread_id": thread["thread_id"], "message_id": message_id, "user_input": user_input, "user_input_timestamp": asked_at.isoformat(),
            "model_response": response, "model_response_timestamp": _now().isoformat() if response else None, "model_response_status": status,
            "relevant_segments": json.dumps([{k: s[k] for k in ("doc_id", "kb_id", "chunk_start", "chunk_end")} for s in segments]),
            "search_queries": json.dumps(queries, ensure_ascii=False), "citations": json.dumps(citations, ensure_ascii=False), "received_at": _now(),
        }

    @staticmethod
    def _answer(raw: str, segments: list[dict]) -> tuple[str, list[dict]]:
        """A model's answer: JSON {"response", "citations"} or plain text; citations of unknown sources are dropped."""
        try:
            parsed = json.loads(raw)
            text, cited = str(parsed["response"]), parsed.get("citations") or []
        except (ValueError, TypeError, KeyError, AttributeError):
            return raw, []
        by_index = {s["source_index"]: s for s in segments}
        kept = [c for c in cited if isinstance(c, dict) and c.get("source_index") in by_index]
        return text, [c | {k: by_index[c["source_index"]][k] for k in ("doc_id", "kb_id")} for c in kept]

    def stream(self, thread: dict, user_input: str, interactions: DataFrame | None = None, metadata_filter: dict | None = None, return_mode: str = "text") -> Iterator[dict]:
        """The states of an exchange: pending, streaming with a growing answer, finished — or failed.

        A thread over a base that isn't there is answered, as failed, by a message that says so.
        """
        if return_mode not in RETURN_MODES:
            raise ValueError(f"return_mode must be one of {', '.join(RETURN_MODES)}")
        for state in self._states(thread, user_input, interactions, metadata_filter, return_mode):
            if self.lake is not None:
                self.lake.append("interactions", self.rows([state]))
            yield state

    def _states(self, thread: dict, user_input: str, interactions: DataFrame | None, metadata_filter: dict | None, return_mode: str) -> Iterator[dict]:
        message_id, asked_at = str(uuid.uuid4()), _now()
        state = lambda *x: self._state(thread, message_id, user_input, asked_at, *x)
        yield state("pending", None, [], [], [])
        if missing := self.missing(thread):
            yield state("failed", f"These knowledge bases are not available: {', '.join(missing)}.", [], [], [])
            return
        try:
            with step(log, "turn", query_id=message_id):
                prompt, segments, queries = self.prepare(thread, user_input, interactions, metadata_filter, return_mode)
                text, citations, raw = "", [], ""
                messages = [{"role": "user", "content": prompt}]
                if type(self.model).partials is LanguageModel.partials:
                    text, citations = self._answer(self.model.answer([prompt])[0], segments)
                    words = text.split(" ")
                    for i in range(20, len(words), 20):
                        yield state("streaming", " ".join(words[:i]), segments, queries, [])
                else:
                    for raw in self.model.partials(messages):
                        so_far = str(unfinished_json(raw).get("response", "")) if raw.lstrip().startswith("{") else raw
                        if so_far and so_far != text:
                            text = so_far
                            yield state("streaming", text, segments, queries, [])
                    text, citations = self._answer(raw, segments)
        except ValueError:
            raise
        except Exception:  # noqa: BLE001
            yield state("failed", None, [], [], [])
            return
        yield state("finished", text, segments, queries, citations)

    def respond(self, thread: dict, user_input: str, interactions: DataFrame | None = None, metadata_filter: dict | None = None, return_mode: str = "text") -> dict:
        """The last state of an exchange."""
        last: dict = {}
        for last in self.stream(thread, user_input, interactions, metadata_filter, return_mode):
            pass
        return last

    def rows(self, states: list[dict]) -> DataFrame:
        """States as rows of the interactions table."""
        names = [x.split(" ")[0] for x in STATE.split(", ")]
        return self.spark.createDataFrame([tuple(s[n] for n in names) for s in states], STATE)
