"""Extension points: providers are injected, configured by JSON and found again by their class name."""

from __future__ import annotations

import importlib
import json
import zlib
from abc import ABC, abstractmethod
from collections.abc import Iterator

import numpy as np


class Plugin:
    """A family of classes that can be stored as {"subclass_name": …, parameters} and rebuilt from it.

    A subclass is known as soon as it is defined; its constructor's keyword
    arguments are its parameters.
    """

    family: dict[str, type]

    def __init_subclass__(cls, **kwargs):
        super().__init_subclass__(**kwargs)
        if Plugin in cls.__bases__:
            cls.family = {}
        else:
            cls.family[cls.__name__] = cls

    def __init__(self, **parameters):
        self.parameters = parameters

    def to_dict(self) -> dict:
        return {"subclass_name": type(self).__name__} | self.parameters

    @classmethod
    def from_dict(cls, config: dict) -> "Plugin":
        rest = dict(config)
        name = rest.pop("subclass_name", None)
        if name not in cls.family:
            raise ValueError(f"unknown {cls.__name__}: {name!r}; known: {', '.join(sorted(cls.family)) or 'none'}")
        return cls.family[name](**rest)


class Embedding(Plugin, ABC):
    """Texts to vectors of `dimension` numbers."""

    dimension: int

    @abstractmethod
    def get_embeddings(self, texts: list[str], input_type: str | None = None) -> list[list[float]]: ...


class HashedWords(Embedding):
    """Vectors without a model: hashed character trigrams of words, weighted by the root of their count, of length one."""

    def __init__(self, dimension: int = 64):
        super().__init__(dimension=dimension)
        self.dimension = dimension

    def get_embeddings(self, texts: list[str], input_type: str | None = None) -> list[list[float]]:
        out = np.zeros((len(texts), self.dimension), np.float32)
        for row, text in zip(out, texts):
            for word in (text or "").lower().split():
                padded = f" {word} "
                for i in range(len(padded) - 2):
                    h = zlib.crc32(padded[i : i + 3].encode())
                    row[h % self.dimension] += 1.0 if h >> 31 else -1.0
            row[:] = np.sign(row) * np.sqrt(np.abs(row))
            if size := float(np.linalg.norm(row)):
                row /= size
        return out.tolist()


class Reranker(Plugin, ABC):
    """Scores in [0, 1] of texts for queries."""

    transform: str | None = None

    @abstractmethod
    def score(self, queries: list[str], texts: list[str]) -> list[float]: ...


class NoReranker(Reranker):
    """Keeps the order of the search."""

    def __init__(self, ignore_absolute_relevance: bool = False):
        super().__init__(ignore_absolute_relevance=ignore_absolute_relevance)
        self.ignore_absolute_relevance = ignore_absolute_relevance

    def score(self, queries: list[str], texts: list[str]) -> list[float]:
        return [0.8 if self.ignore_absolute_relevance else 0.0] * len(texts)


class WordReranker(Reranker):
    """Share of the query's words that the text holds."""

    def score(self, queries: list[str], texts: list[str]) -> list[float]:
        from corpusloom.operators.rerank import shared_words

        return shared_words(queries, texts)


class LanguageModel(Plugin, ABC):
    """Prompts to answers.  `serves` names the beginnings of the model names that a provider answers for."""

    serves: tuple[str, ...] = ()

    @abstractmethod
    def answer(self, prompts: list[str]) -> list[str]: ...

    def chat(self, messages: list[dict], images: tuple[bytes, ...] = (), **options) -> str:
        """The answer to messages [{"role", "content"}], with images to the last one; providers that see images override this."""
        if images:
            raise ValueError(f"{type(self).__name__} takes no images")
        return self.answer(["\n\n".join(f"{m['role']}: {m['content']}" for m in messages)])[0]

    def partials(self, messages: list[dict], **options) -> Iterator[str]:
        """The answer as it grows, each item all of it so far; providers that stream override this."""
        yield self.chat(messages, **options)

    @classmethod
    def serving(cls, name: str, **parameters) -> "LanguageModel":
        """A provider for a model name: the one whose `serves` matches most of it."""
        fits = [(len(start), kind.__name__, kind) for kind in cls.family.values() for start in kind.serves if name.startswith(start)]
        if not fits:
            raise ValueError(f"no provider serves {name!r}")
        return max(fits, key=lambda f: f[:2])[2](**parameters)


def _typed(value, kind) -> bool:
    """Whether a JSON value is of a kind: a type, [kind of the items], {key: kind}, or a tuple of alternatives."""
    if isinstance(kind, tuple):
        return any(_typed(value, k) for k in kind)
    if isinstance(kind, list):
        return isinstance(value, list) and all(_typed(v, kind[0]) for v in value)
    if isinstance(kind, dict):
        return isinstance(value, dict) and all(_typed(value.get(k), v) for k, v in kind.items())
    if kind is None:
        return value is None
    return isinstance(value, kind) and not (isinstance(value, bool) and kind in (int, float))


def first_json(text: str) -> dict:
    """The first JSON object in a text, whatever stands around it; ValueError if there is none."""
    decoder, at = json.JSONDecoder(), text.find("{")
    while at >= 0:
        try:
            found, _ = decoder.raw_decode(text, at)
            return found
        except ValueError:
            at = text.find("{", at + 1)
    raise ValueError("no JSON object")


def unfinished_json(text: str) -> dict:
    """What a JSON object that breaks off holds so far: open strings, lists and objects are closed, a name without a value is left out."""
    at = text.find("{")
    body = text[at:] if at >= 0 else ""
    while body:
        ends, inside, escaped = [], False, False
        for c in body:
            if inside:
                inside, escaped = not (c == '"' and not escaped), c == "\\" and not escaped
            elif c == '"':
                inside, escaped = True, False
            elif c in "{[":
                ends.append("}" if c == "{" else "]")
            elif c in "}]" and ends:
                ends.pop()
                if not ends:
                    break
        try:
            found = json.loads(body.rstrip().rstrip(",") + ('"' if inside and not escaped else "") + "".join(reversed(ends))) if not escaped else None
            if isinstance(found, dict):
                return found
        except ValueError:
            pass
        body = body[:-1]
    return {}


def structured(model: LanguageModel, messages: list[dict], kind: dict, attempts: int = 3, images: tuple[bytes, ...] = (), **options) -> dict:
    """A model's answer as a JSON object of a kind (see _typed); an answer that isn't is sent back with what is wrong, `attempts` times in all."""
    asked, wrong = list(messages), ""
    for _ in range(attempts):
        raw = model.chat(asked, images, **options)
        try:
            found = first_json(raw)
        except ValueError as e:
            wrong = str(e)
        else:
            bad = [k for k, v in kind.items() if not _typed(found.get(k), v)]
            if not bad:
                return found
            wrong = "missing or of another type: " + ", ".join(bad)
        asked = [*messages, {"role": "assistant", "content": raw}, {"role": "user", "content": f"Answer with one JSON object. {wrong}."}]
    raise ValueError(f"no structured answer in {attempts} attempts: {wrong}")


class FirstWords(LanguageModel):
    """An answer without a model: the first words of the prompt's last paragraph."""

    def __init__(self, words: int = 12):
        super().__init__(words=words)
        self.words = words

    def answer(self, prompts: list[str]) -> list[str]:
        return [" ".join((p or "").strip().split("\n\n")[-1].split()[: self.words]) for p in prompts]


class PageReader(Plugin, ABC):
    """A page image to elements: JSON [{"type": …, "content": …}]."""

    @abstractmethod
    def read(self, image: bytes, instructions: str) -> str: ...


class PageRenderer(Plugin, ABC):
    """A file to page images and to page texts."""

    @abstractmethod
    def images(self, content: bytes, dpi: int) -> list[bytes]: ...

    @abstractmethod
    def texts(self, content: bytes) -> list[str]: ...


class Optional_:
    """A module that is imported when it is first used; if it is missing, the error says what needs it."""

    def __init__(self, module: str, needed_for: str):
        self._name, self._needed_for, self._held = module, needed_for, None

    def __getattr__(self, name: str):
        if self._held is None:
            try:
                self._held = importlib.import_module(self._name)
            except ImportError as e:
                raise ImportError(f"{self._needed_for} needs the package {self._name!r}, which is not installed") from e
        return getattr(self._held, name)
