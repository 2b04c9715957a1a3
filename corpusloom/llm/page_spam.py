"""Pages of keywords, links and tags instead of sentences.

1. Two views of every page.  Structure: how its words are spread over sentences,
   link lists, tag lists, uniform catalogue lines, tables and references, and how
   much of it a few words make up.  Language and links: function words and the
   runs between them, marks, digits, capitals, addresses, repeated pairs of words,
   lengths of words and lines.
2. Weak labels from the clear cases of the first view; all other pages get none.
3. Bagged decision trees learn the labels from the second view alone, on a
   bounded sample of the labelled pages (`sample_rows`, chosen by a hash of the
   id).  So they don't repeat the rule that made the labels: they judge pages that
   it leaves open, and can overrule it.
4. Every page gets the mean vote of the trees; the spam rate of its host (all
   pages of the source) then shifts the page's odds, by a bounded amount, so a
   doubtful page follows its host and a clear one does not.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.session import cut

WORD = re.compile(r"[^\W_]+")
URL = re.compile(r"(?:https?://|www\.)[^\s)\]>]+")
LINK = re.compile(r"\[[^\]\n]*\]\([^)\n]*\)|(?:https?://|www\.)[^\s)\]>]+")
TAG = re.compile(r"(?<!\w)#[^\W\d_]\w*")
REFERENCE = re.compile(r"^\s*(?:\[\d{1,4}\]|\(\d{1,4}\)|\d{1,4}\.)\s+\S.*(?:https?://|www\.|doi)", re.I)
ENDS = re.compile(r"[.!?。！？]+[\"”»’)\]]*(?=\s|$)")
_NUMBER, _WORDS = re.compile(r"\d[\d.,]*"), re.compile(r"[^\W_]+(?:[ '’-][^\W\d_]+)*")
#: The most frequent function words of the four languages; sentences hold them, keyword lists hardly do.
FUNCTION_WORDS = frozenset(
    "the of and to in is was were are that which by with as at for from it its this these not but if so an a on be has had have while where unless despite within under through after before when they he she we you i or no "
    "der die das den dem des und von vom zu zum zur im ist sind waren nicht auch sich mit auf für bei nach aus an am wie ein eine einen einem einer nur sondern wegen ohne über seit dass weil dabei um bis oder wird wurden haben hat "
    "le la les des du de et un une est sont dans sur par pour avec sans aux au que qui mais aussi non comme selon l d n ont été à ainsi lors depuis après chez ou ce cette "
    "el los las del y una son fue para con sin sobre no sino también según se lo su desde hasta entre así tras o es este esta".split()
)
#: The first view, for the labels, and the second, for the trees.
STRUCTURE = ("sentence_share", "link_share", "tag_share", "uniform_share", "table_share", "reference_share", "list_share", "top_rate")
LANGUAGE = (
    "log_words", "function_rate", "function_types", "longest_bare", "end_rate", "comma_rate", "mark_rate", "url_rate", "digit_rate", "capital_rate", "type_rate", "pair_rate", "word_letters", "line_words",
)
FEATURES = STRUCTURE + LANGUAGE


def shape(line: str) -> str:
    """What a line looks like, words and numbers apart: catalogue lines share one shape."""
    return _WORDS.sub("w", _NUMBER.sub("9", line.strip()))


def features(text: str) -> list[float] | None:
    """The features of a page, none for a page without words."""
    find, known = WORD.findall, FUNCTION_WORDS.__contains__
    every: list[str] = []
    sentence = link = tag = table = reference = listed = ends = lines = urls = 0
    unsaid: list[tuple[str, int, int]] = []
    for line in text.lower().splitlines():
        parts = ENDS.split(line)
        if len(parts) == 1:
            parts = [line]
        held = [find(x) for x in parts]
        size = sum(map(len, held))
        if not size:
            continue
        lines += 1
        ends += len(parts) - 1
        for w in held:
            every += w
        if line.lstrip().startswith("|"):
            table += size
            continue
        linked = 0
        if "://" in line or "www." in line or "](" in line:
            linked = sum(len(find(m)) for m in LINK.findall(line))
            urls += len(URL.findall(line))
            if linked and REFERENCE.match(line):
                reference += size
                continue
            link += linked
        tagged = len(TAG.findall(line)) if "#" in line else 0
        tag += tagged
        told = 0
        if 2 * linked < size and 2 * tagged < size:
            for part, w in zip(parts, held):
                n = len(w)
                if n >= 4 and sum(map(known, w)) >= max(1, 0.12 * n) and part.count(",") <= 0.34 * n:
                    told += n if len(set(w)) >= 0.5 * n / (1 + n / 150) else 0  # keywords repeat themselves; so do, slowly, the words of any text
        sentence += told
        rest = size - told
        if rest:
            listed += rest
            if size >= 3:
                unsaid.append((line, size, rest))
    n = len(every)
    if not n:
        return None
    shapes = [shape(line) for line, _, _ in unsaid]
    often = Counter(shapes)
    uniform = sum(rest for (_, _, rest), x in zip(unsaid, shapes) if often[x] >= 3)
    counts = Counter(every)
    # the most frequent words that are no function words: prose has many of them, each a few times
    top = sum(sorted((c for w, c in counts.items() if c > 2 and w not in FUNCTION_WORDS), reverse=True)[:5])
    per = 1 / n
    at = [-1, *(i for i, w in enumerate(every) if known(w)), n]
    bare = sorted((b - a - 1 for a, b in zip(at, at[1:])), reverse=True)  # runs without a function word
    capitals = sum(w[0].isupper() for w in find(text))
    return [
        sentence * per, link * per, tag * per, uniform * per, table * per, reference * per, listed * per, top * per,
        math.log1p(n), (len(at) - 2) * per, len({w for w in counts if known(w)}) / math.sqrt(n), sum(bare[: 1 + len(bare) // 4]) * per, ends * per, (text.count(",") + text.count(";")) * per,
        sum(map(text.count, "|#/=*•·")) * per, urls * per, sum(c for w, c in counts.items() if w[0].isdigit()) * per, capitals * per, len(counts) / n**0.8, 1 - len(set(zip(every, every[1:]))) / max(1, n - 1), sum(map(len, every)) * per,
        n / lines,
    ]


F_ = {name: i for i, name in enumerate(FEATURES)}


def weak_label(x: np.ndarray) -> np.ndarray:
    """1 for clear spam, 0 for clear prose, -1 for what lies between; x: one row of features per page."""
    at = lambda name: x[:, F_[name]]
    prose = at("sentence_share") + at("table_share") + at("reference_share")
    kind = (at("link_share") > 0.35) | (at("tag_share") > 0.3) | (at("uniform_share") > 0.35) | (at("top_rate") > 0.3)
    spam = (at("list_share") > 0.85) & (at("sentence_share") < 0.1) & kind
    ham = (prose > 0.85) & (at("top_rate") < 0.3)
    return np.where(brief(x), -1, np.where(spam, 1, np.where(ham, 0, -1)))


def brief(x: np.ndarray) -> np.ndarray:
    """Pages of up to 6 words: too few for rates to mean anything."""
    return x[:, F_["log_words"]] < np.log(8)


def brief_vote(x: np.ndarray) -> np.ndarray:
    """1 for a page that is mostly links and tags or a list with a separator every few words."""
    at = lambda name: x[:, F_[name]]
    listed = (at("list_share") > 0.5) & (at("comma_rate") + at("mark_rate") >= 0.25)
    return ((at("link_share") + at("tag_share") > 0.5) | listed).astype(float)


class BaggedTrees:
    """Decision trees on bootstrap samples of binned features, each split on the best of half of them; the vote is the mean of their leaves."""

    def __init__(self, trees: int = 25, depth: int = 6, bins: int = 48, least: int = 5, seed: int = 5):
        self.count, self.depth, self.bins, self.least, self.seed = trees, depth, bins, least, seed

    def fit(self, x: np.ndarray, y: np.ndarray) -> "BaggedTrees":
        cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins + 1)[1:-1])) for j in range(x.shape[1])]
        # cuts lie between values too, so that equal values of new pages fall on the same side
        self.cuts = [np.unique(np.concatenate([c, *(c[:-1] + (c[1:] - c[:-1]) * at for at in np.arange(1, 8) / 8)])) for c in cuts]
        binned = np.stack([np.searchsorted(c, x[:, j], "left") for j, c in enumerate(self.cuts)], axis=1)
        rng = np.random.default_rng(self.seed)
        self.trees = []
        for _ in range(self.count):
            rows = rng.integers(0, len(y), len(y))
            self.trees.append(self._grow(binned[rows], y[rows].astype(float), self.depth, rng))
        return self

    def _grow(self, b: np.ndarray, y: np.ndarray, depth: int, rng: np.random.Generator):
        mean = (y.sum() + 0.5 * 0.02) / (len(y) + 0.02)
        if depth == 0 or len(y) < 2 * self.least or y.min() == y.max():
            return float(mean)
        best = (1e-9, -1, 0)
        whole = len(y) * mean * (1 - mean)
        for j in rng.permutation(b.shape[1])[: -(-b.shape[1] // 2)]:
            size = len(self.cuts[j]) + 1
            n = np.cumsum(np.bincount(b[:, j], minlength=size))[:-1]
            s = np.cumsum(np.bincount(b[:, j], weights=y, minlength=size))[:-1]
            rest, other = len(y) - n, y.sum() - s
            with np.errstate(divide="ignore", invalid="ignore"):
                gain = np.where((n >= self.least) & (rest >= self.least), whole - s * (1 - s / n) - other * (1 - other / rest), -1.0)
            if len(gain) and gain.max() > best[0]:
                top = np.flatnonzero(gain >= gain.max() - 1e-12)
                best = (float(gain.max()), int(j), int(rng.choice(top[len(top) // 4 : len(top) - len(top) // 4])))  # of equally good cuts one near the middle: between the classes the trees differ, so the vote shows doubt
        if best[1] < 0:
            return float(mean)
        left = b[:, best[1]] <= best[2]
        return best[1], best[2], self._grow(b[left], y[left], depth - 1, rng), self._grow(b[~left], y[~left], depth - 1, rng)

    def vote(self, x: np.ndarray) -> np.ndarray:
        binned = np.stack([np.searchsorted(c, x[:, j], "left") for j, c in enumerate(self.cuts)], axis=1)
        total = np.zeros(len(x))

        def walk(node, rows: np.ndarray) -> None:
            if isinstance(node, float):
                total[rows] += node
            elif len(rows):
                left = binned[rows, node[0]] <= node[1]
                walk(node[2], rows[left])
                walk(node[3], rows[~left])

        for tree in self.trees:
            walk(tree, np.arange(len(x)))
        return total / max(1, len(self.trees))


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows, values = [], []
        for i, text in enumerate(batch.column(2).to_pylist()):
            if text and (v := features(text)):
                rows.append(i)
                values.append(v)
        x = np.asarray(values, np.float32).reshape(-1, len(FEATURES))
        at = pa.array(rows, pa.int64())
        lists = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), len(FEATURES)).cast(pa.list_(pa.float32()))
        yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), lists, pa.array(weak_label(x).astype(np.int32))], names=["doc_id", "host", "x", "label"])


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, len(FEATURES))


def _votes(model: BaggedTrees | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column(2))
            if model is None:
                label = weak_label(x)
                vote = np.where(label >= 0, label, x[:, F_["list_share"]])
            else:
                vote = model.vote(x[:, len(STRUCTURE) :])
            vote = np.where(brief(x), brief_vote(x), vote).astype(float)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(vote)], names=["doc_id", "host", "vote"])

    return run


def spam_scores(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", sample_rows: int = 20_000, weight: float = 0.4, most_shift: float = 1.5) -> DataFrame:
    """(doc_id, host, vote, score): the trees' vote and the vote smoothed by the host's rate, both from 0 to 1.

    Defined cases: pages without a word (null, empty, blank) get no row; a null
    host smooths nothing; repeated ids get a row each; without pages of both weak
    labels the label rule itself votes; an empty table gives an empty result.
    Other columns are ignored.
    """
    rows = documents.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(host_col).cast("string").alias("host"), F.col(text_col).alias("text")).where("doc_id is not null and text is not null")
    table = cut(rows.mapInArrow(_features, "doc_id bigint, host string, x array<float>, label int"))
    counts = {r.label: r["count"] for r in table.groupBy("label").count().collect()}
    sample_x, sample_y = [], []
    for label in (0, 1):
        have = counts.get(label, 0)
        share = min(1.0, sample_rows / 2 / max(1, have))
        picked = table.where((F.col("label") == label) & (F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(share * (1 << 30)))).select("x").toArrow().column(0)
        x = np.concatenate([_matrix(c) for c in picked.chunks]) if picked.num_chunks else np.zeros((0, len(FEATURES)), np.float32)
        sample_x.append(x)
        sample_y.append(np.full(len(x), label))
    x, y = np.concatenate(sample_x), np.concatenate(sample_y)
    order = np.lexsort((*x.T, y))  # the fit doesn't depend on the order of rows
    if 0 < y.sum() < len(y):
        voted = table.select("doc_id", "host", "x").mapInArrow(_votes(BaggedTrees(least=max(1, min(5, int(min(y.sum(), len(y) - y.sum())) // 4))).fit(x[order][:, len(STRUCTURE) :], y[order])), "doc_id bigint, host string, vote double")
    else:
        # too little to learn from: the share of listed words decides
        voted = table.select("doc_id", "host", "x").mapInArrow(_votes(None), "doc_id bigint, host string, vote double")
    voted = cut(voted)  # read for the hosts and for the pages
    logit = lambda p: F.log(p / (1 - p))
    inside = lambda p: F.greatest(F.lit(0.02), F.least(F.lit(0.98), p))
    rate = (counts.get(1, 0) + 1) / (sum(counts.values()) + 2)
    # 20 pages' worth of the overall rate keep small hosts near it
    hosts = voted.where("host is not null").groupBy("host").agg(((F.sum("vote") + 20 * rate) / (F.count(F.lit(1)) + 20)).alias("rate"))
    shift = F.coalesce(weight * (logit(inside(F.col("rate"))) - logit(inside(F.lit(rate)))), F.lit(0.0))
    shift = F.greatest(F.lit(-most_shift), F.least(F.lit(most_shift), shift))
    odds = logit(inside(F.col("vote"))) + shift
    return voted.join(hosts, "host", "left").select("doc_id", "host", "vote", (1 / (1 + F.exp(-odds))).alias("score"))


def spam_pages(documents: DataFrame, threshold: float = 0.5, **options) -> DataFrame:
    """doc_id of the pages whose smoothed score passes the threshold; see spam_scores for the defined cases."""
    return spam_scores(documents, **options).where(F.col("score") > threshold).select("doc_id")
