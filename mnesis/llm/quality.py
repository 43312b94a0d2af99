"""Statistics of each document's text, and a classifier that tells prose from lists, tables and junk.

*Statistics* (:data:`STATISTICS`) are computed for every document in one scan over whole texts. Some
count characters and words; the shares count the characters of lines by the form of the line.
*Weak labels* vote from the shares of lines and a few signs of junk. *Gradient-boosted trees* are
trained on a bounded sample (``TRAIN_ROWS``) of weakly labelled documents, half of it of the rarer
forms. They don't see what the labels are made of (:data:`LABEL_PARTS`), so they learn the forms from
other signs and decide where the labels abstain. They are calibrated on one half of the hand-checked
documents (those whose annotators agree on one of the four forms, ``HOLDOUT_ROWS`` at most); the other
half is kept apart for :func:`report`.

Scale. One scan in Arrow batches, written to the shared folder; the sample goes to the driver within
its bound; scoring is a second scan over the statistics only. The label join is on doc_id.

Edge cases. Null and blank texts have null statistics and no form. Very long texts are used whole.
Without usable labels the trees stay uncalibrated; without any document the result is empty. Repeated
doc_ids give a row each in the statistics and one in the forms. Other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnesis.llm.boosting import BoostedTrees
from mnesis.workspace import materialize, spread

FORMS = ("prose", "list", "table", "junk")
TRAIN_ROWS, HOLDOUT_ROWS = 8_000, 4_000
#: Share of wrongly decoded characters above which a whole text counts as garbled.
GARBLED = 0.1

#: Common function words of English, German and French.
COMMON_WORDS = frozenset(
    """
    a about after again all also an and any are as at be because been before but by came can could do does each even
    except first for from had has have he her his how if in into is it its just last like many more most much no nobody
    not of on once one only or other our out over should since so some such than that the their them then there these they
    this those to too under until up us was we were what when where which while who why will with would you
    aber alle als am auch auf aus bei das dass dem den der des die doch ein eine einem er es für hat haben ich im ist ja
    mit nach nicht noch nur oder sein sie sind und uns von vor war weil wenn wie wir wird wurde zu zum zur zwar
    au aux avec ce cette dans de du elle en est et il je la le les leur mais ne nous ou par pas plus pour qu que qui sans
    se sont sur un une vous
    """.split()
)

_WORD = re.compile(r"[^\W_]+")
_BULLET = re.compile(r"\s*(?:[-*+•–—·◦‣▪●]|\(?\d{1,3}[.)]|\(?[a-zA-Z][.)]|\[[ xX]\]|[一二三四五六七八九十]+、)\s+\S")
_LINK = re.compile(r"\s*\[[^\]]*\]\([^)]*\)\s*$")
_TRACE = re.compile(r"""\s*(?:at\s+\S+\s*\(.*\)|File\s+".*",\s+line\s+\d+.*|\.\.\.\s+\d+\s+more|Traceback\b.*|\S*(?:Error|Exception):.*)\s*$""")
_DUMP = re.compile(r"\s*[0-9a-fA-F]{4,}:?\s+(?:[0-9a-fA-F]{2,4}\s*){4,}")
_PAIR = re.compile(r"[\"']?\b[^\s=:,;]+[\"']?=\S*")
_TAG = re.compile(r"</?(?:tr|td|th|table|tbody|thead)\b", re.I)
_COLUMNS = re.compile(r"\S(?: {2,}|\t)(?=\S)")
_HEAD = re.compile(r"\s*(?:#{1,6}\s|={1,6}\s|[=\-*_~]{3,}\s*$)")
_FIELD = re.compile(r"\s*[\"']?[\w.\- ]{1,30}[\"']?\s*:\s+\S")
_LONG = re.compile(r"\S{40,}")
_END = tuple(".!?。！？…:;\"”»)")
_SENTENCE = re.compile(r"(?<=[.!?。！？])\s*")
_CJK = re.compile(r"[⺁-鿾가-힣]")
_LATIN1 = re.compile(r"[\x80-\xffŒœŠšŸŽžƒˆ˜‘-„†-•…‰‹›€™]")
_UMLAUT = re.compile(r"[äöüÄÖÜßéèêàâçôîûùëïÉÈÀ«»§°]")
_CJK_FIELDS = re.compile(r"[,、，;；]\s*")
_FIELDS = re.compile(r"[,;]\s+")
_UPPER = re.compile(r"[A-ZÄÖÜ]")
_WIDE = re.compile(r"[０-９Ａ-Ｚａ-ｚ]")
_NARROW = {c: c - 0xFEE0 for c in (*range(0xFF10, 0xFF1A), *range(0xFF21, 0xFF3B), *range(0xFF41, 0xFF5B))}
_HEX_PAIRS = frozenset(f"{i:02x}" for i in range(256))
_MARKED = re.compile(r"^[ \t]*(?:[^\w\s]|\(?\w{1,3}[.)、])[ \t]", re.M)
_VOWELLESS = re.compile(r"[bcdfghjklmnpqrstvwxz]{5,}", re.I)

STATISTICS = (
    "chars words lines mean_word_length longest_word mean_line_words symbol_ratio digit_ratio upper_ratio space_ratio "
    "end_punctuation common_words distinct_words distinct_sentences repeated single_letters cjk garbled consonants hex_words "
    "long_tokens words_per_sentence commas_per_word prose_share list_share table_share junk_share bullet_share short_share "
    "loose_share common_in_text distinct_lines bars_per_line tabs_per_line gaps_per_line equals_per_word colons_per_word "
    "tags_per_line brackets_per_word slashes_per_word marked_lines short_lines long_lines line_spread compressed vowels "
    "stops_per_word cjk_stops cjk_pauses common_spread plain_lines"
).split()
#: What the weak labels are made of. The trees don't see it, so they have to tell the forms by other signs.
LABEL_PARTS = frozenset("prose_share list_share table_share junk_share bullet_share short_share loose_share common_in_text".split())
FEATURES = [x for x in STATISTICS if x not in LABEL_PARTS]
SCHEMA = ", ".join(f"{s} float" for s in STATISTICS) + ", weak int"


def _common(ws: list[str]) -> float:
    return sum(map(COMMON_WORDS.__contains__, ws)) / len(ws) if ws else 0.0


def _line_form(line: str, s: str, ws: list[str], cjk: int) -> str:
    """``table``, ``junk``, ``bullet``, ``list``, ``head``, ``short`` or ``text``; ``s`` is the line
    stripped, ``ws`` its words in lower case."""
    n = len(s)
    tokens = s.split()
    marked = "|" in s or "\t" in s or "<" in s or "=" in s
    if len(tokens) > 8 and not marked and s.isascii() and _common(ws) >= 0.2 and not _BULLET.match(line) and "   " not in s:
        return "text"
    if _TRACE.match(s) or _DUMP.match(s):
        return "junk"
    if "<" in s and _TAG.search(s):
        return "table"
    if len(tokens) >= 8 and not cjk and sum(len(t) == 1 for t in tokens) > 0.7 * len(tokens):
        return "junk"
    alnum = sum(map(len, ws))
    if n >= 4 and alnum < 0.25 * n and not any(c in s for c in "|\t,-=") or n >= 8 and alnum < 0.1 * n and not set(s) <= set("|-: +=*_#~"):
        return "junk"
    bars = s.count("|")
    if bars >= 2 or bars and s[0] == s[-1] == "|":
        cells = [c.strip() for c in s.strip("|").split("|")]
        if alnum < 0.3 * n and len(ws) * 3 < bars:
            return "table" if set(s) <= set("|-: +") else "junk"
        named = [c for c in cells if c]
        if s[0] != "|" and len(named) >= 6 and all(c.isalpha() and len(c) < 20 and c[0].isupper() for c in named):
            return "junk"  # navigation
        return "table"
    if "\t" in s:
        return "table"
    if "=" in s:
        pairs = _PAIR.findall(s)
        if len(pairs) >= 2 and len(pairs) >= 0.6 * len(tokens):
            return "table"
    if not s.isascii() and cjk < 0.1 * n and len(_LATIN1.findall(s)) - len(_UMLAUT.findall(s)) > 0.12 * n:
        return "junk"
    if _BULLET.match(line):
        return "bullet"
    if _LINK.match(s):
        return "list"
    commas = s.count(",") + s.count(";")
    if commas >= 2 and s.count(", ") + s.count("; ") <= 0.2 * commas and not s.endswith(("。", ".")) and len(tokens) <= commas + 2:
        return "table"
    if len(tokens) <= 14 and "  " in s and len(_COLUMNS.findall(line.rstrip())) >= 2:
        return "table"
    if n >= 40 and not cjk and max(map(len, tokens)) > max(39, 0.6 * n):
        return "junk"
    if _HEAD.match(line):
        return "head"
    if cjk > 0.15 * n:
        if any(c in s for c in "。！？"):
            return "text"
        fields = _CJK_FIELDS.split(s)
        return "list" if len(fields) >= 5 and n / len(fields) < 12 else "short" if n <= 24 else "text"
    if commas >= 3 and _common(ws) < 0.12:
        fields = _FIELDS.split(s)
        if len(fields) >= 4 and len(ws) <= 5 * len(fields):
            return "list"
    return "short" if len(tokens) <= 8 else "text"


def statistics(text: str | None) -> tuple[list[float], int] | None:
    """The numbers of :data:`STATISTICS` and the weak label (a form's place, or -1); none of a blank text."""
    if text is None or not text.strip():
        return None
    ascii_ = text.isascii()
    if not ascii_ and _WIDE.search(text):
        text = text.translate(_NARROW)
    share: Counter[str] = Counter()
    said: list[str] = []  # what reads as text
    said_words: list[str] = []
    run: list[tuple[str, list[str]]] = []  # short lines in a row, whose form their common words decide
    loose_list = loose = bullets = ended = count_lines = 0
    lower: list[str] = []
    hits: list[bool] = []  # which of the words are common
    line_sizes: list[int] = []
    plain_lines = 0
    distinct: set[str] = set()

    def close_run() -> None:
        nonlocal loose_list, loose
        if not run:
            return
        joined = " ".join(x for x, _ in run)
        size = sum(len(x) for x, _ in run)
        ws = [w for _, xs in run for w in xs]
        plain = _common(ws) >= 0.17 or (len(run) == 1 and (joined.endswith(("。", "!", "?", "！", "？")) or size <= 60))
        if not plain and not ascii_ and _CJK.search(joined) and not _FIELD.match(joined):
            plain = "。" in joined or len(run) == 1
        share["prose" if plain else "list"] += size
        if plain:
            said.append(joined)
            said_words.extend(ws)
            loose += 1
        else:
            loose_list += size
        run.clear()

    for line in text.splitlines():
        s = line.strip()
        if not s:
            continue
        count_lines += 1
        ended += s.endswith(_END)
        distinct.add(s)
        ws = _WORD.findall(s.lower())
        lower += ws
        known = list(map(COMMON_WORDS.__contains__, ws))
        hits += known
        plain_lines += sum(known) >= 0.2 * len(ws) > 0
        size = len(s)
        line_sizes.append(size)
        cjk = 0 if ascii_ else len(_CJK.findall(s))
        form = _line_form(line, s, ws, cjk)
        if form == "short":
            run.append((s, ws))
            continue
        close_run()
        if form == "text":
            said.append(s)
            said_words += ws
            share["prose" if cjk > 0.15 * size or _common(ws) >= 0.1 else "junk"] += size
        elif form == "bullet":
            bullets += size
            share["list"] += size
        else:
            share["prose" if form == "head" else form] += size
    close_run()

    sizes = list(map(len, lower))
    count, chars = max(1, len(lower)), len(text)
    pieces = _SENTENCE.split(" ".join(said))
    sentences = [x for x in map(str.strip, pieces) if len(x) > 20]
    times = Counter(sentences)
    repeated = sum(len(x) * (k - 1) for x, k in times.items() if k > 1) / max(1, sum(map(len, sentences)))
    garbled = 0 if ascii_ else max(0, len(_LATIN1.findall(text)) - len(_UMLAUT.findall(text)))
    if repeated > 0.5 or garbled > GARBLED * chars:  # then what reads as prose is repetition or an accident
        share["junk"] += share["prose"]
        share["prose"] = 0
    total = sum(share.values()) or 1
    parts = [share[f] / total for f in FORMS]
    spaces, alnum = sum(map(text.count, " \n\t\r")), sum(sizes)
    values = [
        chars,
        len(lower),
        count_lines,
        alnum / count,
        max(sizes, default=0),
        len(lower) / max(1, count_lines),
        (chars - alnum - spaces) / chars,
        sum(map(text.count, "0123456789")) / chars,
        len(_UPPER.findall(text)) / count,
        spaces / chars,
        ended / max(1, count_lines),
        sum(hits) / count,
        len(set(lower)) / count,
        len(times) / max(1, len(sentences)),
        repeated,
        sizes.count(1) / count,
        0.0 if ascii_ else len(_CJK.findall(text)) / chars,
        garbled / chars,
        len(_VOWELLESS.findall(text)) / count,
        sum(map(_HEX_PAIRS.__contains__, lower)) / count,
        sum(map(len, _LONG.findall(text))) / chars,
        len(lower) / max(1, len(pieces)),
        (text.count(",") + text.count(";") + text.count("，")) / count,
        *parts,
        bullets / total,
        loose_list / total,
        loose / max(1, count_lines),
        _common(said_words),
        len(distinct) / max(1, count_lines),
    ]
    values += _surface(text, hits, plain_lines, line_sizes, count, chars, alnum)
    top = int(np.argmax(parts[1:])) + 1
    # weak votes: only of clear shares
    if parts[0] > 0.5:
        return values, 0 if parts[0] > 0.55 else -1
    return values, top if parts[top] > 0.45 else -1


def _surface(text: str, hits: list[bool], plain: int, line_sizes: list[int], count: int, chars: int, alnum: int) -> list[float]:
    """Counts of marks, lines and characters that no label is made of."""
    lines = max(1, len(line_sizes))
    total, n = max(1, sum(line_sizes)), lines
    mean = total / n
    raw = text.encode("utf-8", "replace")
    # common words in tenths of the text: prose has them throughout
    step = max(1, -(-len(hits) // 10))
    tenths = [sum(hits[i : i + step]) / len(hits[i : i + step]) for i in range(0, len(hits), step)]
    many = text.count
    return [
        many("|") / lines,
        many("\t") / lines,
        many("  ") / lines,
        many("=") / count,
        (many(":") + many("：")) / count,
        many("<") / lines,
        sum(map(many, "()[]{}")) / count,
        (many("/") + many("\\")) / count,
        len(_MARKED.findall(text)) / lines,
        sum(x for x in line_sizes if x <= 30) / total,
        sum(x for x in line_sizes if x >= 80) / total,
        math.sqrt(sum((x - mean) ** 2 for x in line_sizes) / n) / max(1.0, mean),
        len(_compressor().compress(raw)) / len(raw),
        sum(map(many, "aeiouyäöüéè")) / max(1, alnum),
        (many(". ") + many(".\n") + many("? ") + many("! ")) / count,
        sum(map(many, "。！？")) / chars,
        sum(map(many, "，、；")) / chars,
        min(tenths, default=0.0),
        plain / lines,
    ]


@lru_cache(maxsize=1)
def _compressor():
    import zstandard

    return zstandard.ZstdCompressor(1)


def document_statistics(documents: DataFrame) -> DataFrame:
    """``(doc_id, <statistics>, weak)`` of every document, null where the text is null or blank."""

    def compute(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        empty = [None] * len(STATISTICS), None
        for batch in batches:
            rows = [statistics(t) or empty for t in batch["text"]]
            out = pd.DataFrame([v for v, _ in rows], columns=list(STATISTICS), dtype="float32")
            out["weak"] = pd.array([w for _, w in rows], dtype="Int32")
            out.insert(0, "doc_id", batch["doc_id"].array)
            yield out

    return spread(documents.select(F.col("doc_id").cast("bigint"), "text")).mapInPandas(compute, f"doc_id bigint, {SCHEMA}")


def train(stats: DataFrame, labels: DataFrame | None, seed: int = 3) -> BoostedTrees | None:
    """Trees on a bounded sample of weakly labelled statistics, calibrated on one half of the hand-checked
    labels (the other half is kept for :func:`report`)."""
    usable = stats.where("weak >= 0").withColumn("draw", F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 30)) / F.lit(float(1 << 30)))
    sizes = {r.weak: r.n for r in usable.groupBy("weak").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return None
    rare = sum(n for f, n in sizes.items() if f)
    share = F.when(F.col("weak") == 0, min(1.0, 0.45 * TRAIN_ROWS / max(1, sizes.get(0, 0)))).otherwise(min(1.0, 0.45 * TRAIN_ROWS / max(1, rare)))
    sample = usable.where(F.col("draw") < share).limit(TRAIN_ROWS).toPandas().sort_values("doc_id", kind="stable")
    y = sample["weak"].to_numpy(dtype=np.int64)
    kept = {f: max(1, int((y == f).sum())) for f in sizes}
    weight = np.array([sizes[f] / kept[f] for f in y])
    model = BoostedTrees(len(FORMS)).fit(sample[FEATURES].to_numpy(dtype=np.float64), y, weight / weight.mean())
    if labels is not None:
        held = hand_checked(stats, labels, seed).where("half = 0").orderBy("draw").limit(HOLDOUT_ROWS).toPandas()
        model.calibrate(held[FEATURES].to_numpy(dtype=np.float64), held["form"].map(FORMS.index).to_numpy(dtype=np.int64))
    return model


def hand_checked(stats: DataFrame, labels: DataFrame, seed: int = 3) -> DataFrame:
    """Statistics of the documents whose annotators agree on one of the four forms, with that ``form`` and
    the ``half`` they fall in: 0 calibrates, 1 is kept apart."""
    agreed = (
        labels.select("doc_id", F.lower(F.trim("form")).alias("form"))
        .where(F.col("form").isin(*FORMS))
        .groupBy("doc_id")
        .agg(F.min("form").alias("form"), F.max("form").alias("other"))
        .where("form = other")
    )
    draw = F.xxhash64("doc_id", F.lit(seed + 1))
    return stats.where("weak is not null").join(agreed.drop("other"), "doc_id").withColumn("draw", draw).withColumn("half", F.pmod(draw, F.lit(2)))


def report(stats: DataFrame, labels: DataFrame, seed: int = 3) -> dict[str, float]:
    """Share of the hand-checked documents kept apart on which each step agrees with the annotators: the
    weak rule (an abstention is wrong), the trees, the calibrated trees."""
    model = train(stats, labels, seed)
    held = hand_checked(stats, labels, seed).where("half = 1").orderBy("draw").limit(HOLDOUT_ROWS).toPandas()
    y = held["form"].map(FORMS.index).to_numpy(dtype=np.int64)
    x = held[FEATURES].to_numpy(dtype=np.float64)
    calibrated = model.probabilities(x).argmax(axis=1)
    return {
        "documents": len(y),
        "rule": float((held["weak"].to_numpy() == y).mean()),
        "trees": float((model.raw(x).argmax(axis=1) == y).mean()),
        "calibrated": float((calibrated == y).mean()),
    }


def classify(documents: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """``(doc_id, form, p_prose, p_list, p_table, p_junk)`` of every document with text."""
    stats = materialize(document_statistics(documents), "doc-statistics")
    model = train(stats, labels)
    schema = "doc_id bigint, form string, " + ", ".join(f"p_{f} double" for f in FORMS)
    spark = documents.sparkSession
    if model is None:
        return spark.createDataFrame([], schema)
    shared = spark.sparkContext.broadcast(model)

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            p = shared.value.probabilities(batch[FEATURES].to_numpy(dtype=np.float64))
            out = pd.DataFrame(p, columns=[f"p_{f}" for f in FORMS])
            # not prose where prose has less than half; then the likeliest of the other forms
            form = np.where(p[:, 0] > 0.5, 0, p[:, 1:].argmax(axis=1) + 1)
            out.insert(0, "form", np.array(FORMS, dtype=object)[form])
            out.insert(0, "doc_id", batch["doc_id"].array)
            yield out

    return stats.where("weak is not null").mapInPandas(score, schema)
