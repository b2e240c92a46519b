"""Quality rules, line first: lines that fail a rule are removed, then documents that lose
too much of their text are rejected.

Boilerplate is learned from the table: a line that at least `SHARED` documents of one source
hold, in documents that have little else in common. Each document names a companion of the
line, the least hash of its other lines: copies of a text name the same one, so that what they
share counts once or little, while a footer comes with as many companions as documents."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .sparkit import bound_batches, settle

# The word and symbol classes, and what lines are tested for.
WORD = re.compile(r"[^\x20\x09-\x0D]+")
SYMBOLS = re.compile(r"[#*$%&|<>]")
ENDS = (".", "!", "?", "…", '"', "'", "”", "’", "»", ")", ":", ";", "。", "！", "？")
NAVIGATION = ("|", "»", ">", "›", "•", "·", "/")
BOILERPLATE = re.compile(r"lorem ipsum|all rights reserved|terms of (use|service)|privacy policy|cookie policy|use cookies|enable javascript|click here|sign up|log ?in to|subscribe to|read more|share this", re.I | re.A)
#: What a text in lower case holds if it holds one of these phrases.
KEYS = ("lorem ipsum", "all rights reserved", "terms of ", "privacy policy", "cookie policy", "use cookies", "enable javascript", "click here", "sign up", "in to", "subscribe to", "read more", "share this")

#: Shares of a line's words above which it fails, of its characters that phrases may take, and
#: of a text that may be lost.
MAX_SYMBOLS, MAX_NAVIGATION, MAX_SHOUTED, MAX_ECHOED, MAX_PHRASES, MAX_LOST = 0.3, 0.2, 0.5, 0.3, 0.05, 0.5
#: Documents of one source that share a learned line, and the least share of companions in them.
SHARED, COMPANIONS = 10, 0.5


def line_fault(line: str, words: list[str], learned: bool = False, phrases: bool = True) -> str | None:
    """The first rule that a line with words fails, or None; learned: the corpus has shown it
    to be boilerplate; phrases: the text may hold one of the phrases."""
    n = len(words)
    if not n:
        return None
    if any(x in line for x in NAVIGATION) and sum(w in NAVIGATION for w in words) > MAX_NAVIGATION * n:
        return "navigation"
    if SYMBOLS.search(line) and sum(SYMBOLS.search(w) is not None for w in words) > MAX_SYMBOLS * n:
        return "symbols"
    if n > 3 and sum(a == b for a, b in zip(words, words[1:], strict=False)) > MAX_ECHOED * n:
        return "repetition"
    if n > 3 and sum(w.isupper() for w in words) > MAX_SHOUTED * n:
        return "shouting"
    if learned or phrases and sum(len(m[0]) for m in BOILERPLATE.finditer(line)) > MAX_PHRASES * len(line):
        return "boilerplate"
    # prose that was cut short still has a sentence's end inside
    if not words[-1].endswith(ENDS) and not any(w.endswith(ENDS) for w in words):
        return "punctuation"
    return None


def judge(text: str | None, learned: frozenset[int] = frozenset()) -> dict:
    """Counts of the whole text, its verdict, and the text without failed lines; learned holds
    the numbers of its lines that are boilerplate."""
    text = text or ""
    words = WORD.findall(text)
    lines = [(x, WORD.search(x) is not None) for x in text.split("\n")]
    seen: set[str] = set()
    dup = 0
    for x, w in lines:
        if w:
            if x in seen:
                dup += 1
            else:
                seen.add(x)
    n = len(words)
    first: dict[tuple[str, str, str], int] = {}
    covered = bytearray(n)
    for i, w in enumerate(zip(words, words[1:], words[2:], strict=False)):
        j = first.setdefault(w, i)
        if j != i:
            covered[j : j + 3] = covered[i : i + 3] = b"\1\1\1"
    repeat = sum(covered)
    failed = n < 50 or 100 * repeat > 50 * n
    kept, faults, lost, total = [], {}, 0, 0
    low = text.lower()
    phrases = any(k in low for k in KEYS)
    for i, (x, w) in enumerate(lines):
        if not w:
            kept.append(x)
            continue
        total += len(x)
        fault = line_fault(x, WORD.findall(x), i in learned, phrases)
        if fault is None:
            kept.append(x)
        else:
            faults[fault] = faults.get(fault, 0) + 1
            lost += len(x)
    return {
        "n_words": n,
        "word_chars": sum(map(len, words)),
        "n_symbols": len(SYMBOLS.findall(text)),
        "n_dup_lines": dup,
        "n_repeat_words": repeat,
        "base_failed": failed,
        "lost_share": lost / total if total else 0.0,
        "kept": not failed and lost <= MAX_LOST * total,
        "faults": ", ".join(f"{k} {v}" for k, v in sorted(faults.items())),
        "clean_text": "\n".join(kept),
    }


_KINDS = {"n_words": "long", "word_chars": "long", "n_symbols": "long", "n_dup_lines": "long", "n_repeat_words": "long", "base_failed": "boolean", "kept": "boolean", "lost_share": "double", "faults": "string", "clean_text": "string"}


def _judged(columns: list[str]) -> Callable:
    def rows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        none = frozenset()
        for f in frames:
            got = pd.DataFrame([judge(t, none if b is None else frozenset(map(int, b))) for t, b in zip(f["_text"], f["_learned"], strict=True)], columns=list(_KINDS), index=f.index)
            yield pd.concat([f[["_key"]], got], axis=1)[columns]

    return rows


def _hashes(text: Column) -> Column:
    """Hashes of the lines, in order; null for a line without a word."""
    return F.transform(F.split(text, "\n", -1), lambda x: F.when(x.rlike(WORD.pattern), F.xxhash64(x)))


def learned_lines(docs: DataFrame, text: str = "text", source: str = "source") -> DataFrame:
    """(source, line): hashes of the lines that are boilerplate in a source. A null source is
    one of its own. Equal lines of a document count once, equal documents of a source too."""
    d = docs.select(F.col(source).cast("string").alias("_src"), F.array_sort(F.array_distinct(F.array_compact(_hashes(F.col(text))))).alias("_h"))
    d = d.filter(F.size("_h") > 1)
    least, next_ = F.element_at("_h", 1), F.element_at("_h", 2)
    # a document is known by its set of lines
    lines = d.select("_src", least.alias("_a"), next_.alias("_b"), F.xxhash64("_h").alias("_doc"), F.explode("_h").alias("line"))
    lines = lines.select("_src", "line", F.when(F.col("line") == F.col("_a"), F.col("_b")).otherwise(F.col("_a")).alias("companion"), "_doc")
    # combined before each shuffle, so a line of very many documents is in no one task: documents
    # that count are told apart by all four columns, then counted by companion, then by line
    each = lines.distinct().groupBy("_src", "line", "companion").agg(F.count(F.lit(1)).alias("docs"))
    of = each.groupBy("_src", "line").agg(F.sum("docs").alias("docs"), F.count(F.lit(1)).alias("companions"))
    return of.filter((F.col("docs") >= SHARED) & (F.col("companions") >= COMPANIONS * F.col("docs"))).select(F.col("_src").alias("source"), "line")


def clean_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", columns: tuple[str, ...] = tuple(_KINDS), source: str = "source") -> DataFrame:
    """For each row: key and the named columns.

    Counts are those of the whole text (null: empty). A line (cut at \\n) without a word is
    no line to judge and is never lost. A document is kept if it isn't base_failed and its
    failed lines hold at most MAX_LOST of the characters of lines with words; clean_text is
    the text without failed lines, whether it is kept or not. Boilerplate is learned from docs
    itself, by source, if it has that column, else from all. Repeated rows are judged alike. An
    empty table gives an empty result. Columns not named are ignored, whatever their names.
    """
    bound_batches(docs.sparkSession)
    kind = docs.schema[key].dataType
    schema = ", ".join(["_key string", *[f"{c} {_KINDS[c]}" for c in columns]])
    src = F.col(source).cast("string") if source in docs.columns else F.lit(None).cast("string")
    d = docs.select(F.col(key).cast("string").alias("_key"), F.col(text).alias("_text"), src.alias("_src"))
    learned = settle(learned_lines(d, "_text", "_src").select(F.col("source").alias("_s"), "line"))
    # numbers of the lines that are boilerplate, for each text and source that has some
    name = F.xxhash64("_text").alias("_name")
    lines = d.select("_src", name, F.posexplode(_hashes(F.col("_text"))).alias("_i", "_line")).filter("_line is not null")
    bad = lines.join(learned, (lines["_line"] == learned["line"]) & lines["_src"].eqNullSafe(learned["_s"]))
    bad = settle(bad.groupBy(F.col("_src").alias("_s"), F.col("_name").alias("_n")).agg(F.collect_set("_i").alias("_learned")))
    # by sorting at every size: what is joined to the texts grows with them
    d = d.join(bad.hint("merge"), (F.xxhash64(d["_text"]) == bad["_n"]) & d["_src"].eqNullSafe(bad["_s"]), "left")
    got = d.select("_key", "_text", F.transform("_learned", lambda x: x.cast("string")).alias("_learned")).mapInPandas(_judged(["_key", *columns]), schema)
    return got.select(F.col("_key").cast(kind).alias(key), *columns)
