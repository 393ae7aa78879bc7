"""Sentence units of documents in many scripts, by a finite transducer.

A text becomes a sequence of few *events*: stops that could end a sentence (abbreviations, decimals, names, ordinals
and dots of omission are told apart by their neighbourhood), opening and closing quotes and brackets, Thai
spaces, and hard breaks (blank lines; headings, list items, log records and key = value lines, one unit each).
A transducer over these symbols knows whether it is inside a quote or bracket and whether that was opened at the start
of a sentence, and marks the events after which a unit ends.

The event sequence of a batch of documents is cut into chunks. Each chunk is a function from states to states;
all chunks are evaluated for all states at once, the functions are composed by a parallel prefix scan, and a
second pass from the then known states marks the boundaries. A document longer than ``range_chars`` is laid out once (blank lines and
lines that are units) and cut into ranges that go to different tasks: each hands in its state function, the functions of a document
are composed in order, and each range then marks its boundaries from the state it begins in. The rules look at most
``HALO`` characters beyond a range.

Null and blank texts have no units. Offsets are code points, end exclusive, without outer white space; the units of
a document cover all its other characters.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shardlight.runtime import shuffle_width, stored

# -- fixed values: the abbreviations of the languages, in lower case and without the last dot ------------------
#: Never end a sentence.
ABBREVIATIONS = frozenset(
    """
    e.g i.e cf vs approx dr mr mrs ms prof st jr sr dept fig. gen sen rep hon rev messrs lt gov col capt sgt maj adm cmdr mt ft
    fr hrsg dipl ing z.b d.h u.a o.ä bzw vgl ca z d u s sog ggf evtl inkl zzgl bzgl geb
    env p.ex c.-à-d c.à.d mme mlle aprox p.ej sr sra dra ud uds ee.uu
    """.split()
)
#: Degrees, after a name or before one: end a sentence only where one of SENTENCE_STARTS follows.
DEGREES = frozenset("ph.d m.d m.sc b.sc m.a b.a m.phil d.phil ll.m ll.b".split())
SENTENCE_STARTS = frozenset("he she it they we you i the this that these those his her their its in on at after before but and when while if there".split())
#: End no sentence where a number follows.
NUMBER_ABBREVIATIONS = frozenset(
    """
    no nos nr nrn fig figs sec secs ver est max min vol p pp ch eq ref art tab abb kap bd § num núm pág págs cap
    n° ص सं पृ approx ca env aprox about hr
    """.split()
)
#: Can be the last word of a sentence.
CLOSING_ABBREVIATIONS = frozenset("etc usw a.m p.m inc ltd co corp al u.s u.s.a b.c a.d ggmbh usf sa cie".split())
#: German words before an ordinal number.
BEFORE_ORDINAL = frozenset("am der dem den des die das vom zum beim im bis ab seit vor nach jeder jedem jeden und".split())
#: Words that continue after dots of omission, in scripts without capitals.
CONTINUATIONS = ("ثم", "फिर", "然后", "その後")

_STOPS = ".!?。！？।॥؟۔…｡"
_HARD_STOPS = frozenset("。！？।॥؟۔｡")
_OPEN_QUOTES, _CLOSE_QUOTES = "«„「『‹《〈", "»”」』›》〉"
_EITHER = "\"“"
_OPEN_BRACKETS, _CLOSE_BRACKETS = "([{（【［", ")]}）】］"
_OPENING = frozenset(_OPEN_QUOTES + _EITHER + _OPEN_BRACKETS + "¿¡'‘")
_LINE = re.compile(
    r"^[^\S\n]*(?:#{1,6}[^\S\n]|(?P<item>[-*+•‣◦][^\S\n]|\(?\d{1,4}\)[^\S\n]|(?P<dot>\d{1,4}\.[^\S\n]))"
    r"|\[?\d{4}-\d\d-\d\d[T ]\d\d:\d\d|\[?(?:TRACE|DEBUG|INFO|WARN|WARNING|ERROR|FATAL|CRITICAL)\b[\]:]?[^\S\n]"
    r"|[^\s=]+[^\S\n]=[^\S\n]|[\w.\-/]+=\S).*$",
    re.M,
)
_BLANK = re.compile(r"\n[^\S\n]*(?:\n\s*)")
_EVENT = re.compile(rf"[{re.escape(_STOPS)}]+|[{re.escape(_OPEN_QUOTES + _CLOSE_QUOTES + _EITHER + _OPEN_BRACKETS + _CLOSE_BRACKETS)}]|(?<=[\u0e00-\u0e7f])[^\S\n]+(?=[\u0e00-\u0e7f])")
_SPACES = re.compile(r"\s*")
_WORD_BEFORE = re.compile(r"[^\s()\[\]{}„“”\"«»「」]*\Z")
_TOKEN = re.compile(r"\S{1,40}")
_CODE = re.compile(r"[\d_]|\w\.\w")
_CONTENT = re.compile(r"\S")

# -- the transducer ------------------------------------------------------------------------------------------
_STATES = 10
START, MID, QUOTE_S, QUOTE_M, BRACKET_S, BRACKET_M, QS_BRACKET, QM_BRACKET, BS_QUOTE, BM_QUOTE = range(_STATES)
(
    WORD, STOP, OPEN_Q, CLOSE_Q, CLOSE_Q_END, CLOSE_Q_IF_MID, EITHER_Q, EITHER_Q_END, EITHER_Q_IF_MID,
    OPEN_B, CLOSE_B, CLOSE_B_END, BREAK,
) = range(13)


def _compile() -> tuple[np.ndarray, np.ndarray]:
    """Next state and end mark for each state and symbol."""
    step = np.tile(np.arange(_STATES)[:, None], (1, 13))
    mark = np.zeros((_STATES, 13), bool)
    step[START, WORD] = MID
    for s in (START, MID):
        step[s, STOP], mark[s, STOP] = START, True
    opened = {START: QUOTE_S, MID: QUOTE_M, BRACKET_S: BS_QUOTE, BRACKET_M: BM_QUOTE}
    closed = {QUOTE_S: MID, QUOTE_M: MID, BS_QUOTE: BRACKET_S, BM_QUOTE: BRACKET_M}
    for symbol in (OPEN_Q, EITHER_Q, EITHER_Q_END, EITHER_Q_IF_MID):
        for s, t in opened.items():
            step[s, symbol] = t
    for symbol in (CLOSE_Q, CLOSE_Q_END, CLOSE_Q_IF_MID, EITHER_Q, EITHER_Q_END, EITHER_Q_IF_MID):
        for s, t in closed.items():
            step[s, symbol] = t
    for symbol in (CLOSE_Q_END, EITHER_Q_END):
        for s in (QUOTE_S, QUOTE_M):
            step[s, symbol], mark[s, symbol] = START, True
    for symbol in (CLOSE_Q_IF_MID, EITHER_Q_IF_MID):
        step[QUOTE_M, symbol], mark[QUOTE_M, symbol] = START, True
    for s, t in {START: BRACKET_S, MID: BRACKET_M, QUOTE_S: QS_BRACKET, QUOTE_M: QM_BRACKET}.items():
        step[s, OPEN_B] = t
    for symbol in (CLOSE_B, CLOSE_B_END):
        for s, t in {BRACKET_S: MID, BRACKET_M: MID, QS_BRACKET: QUOTE_S, QM_BRACKET: QUOTE_M}.items():
            step[s, symbol] = t
    step[BRACKET_S, CLOSE_B_END], mark[BRACKET_S, CLOSE_B_END] = START, True
    step[:, BREAK], mark[:, BREAK] = START, True
    return step.astype(np.uint8), mark


_STEP, _MARK = _compile()


def run_transducer(symbols: np.ndarray, chunk: int = 64) -> np.ndarray:
    """End marks of a symbol sequence that begins in START, by a parallel prefix scan over chunks."""
    n = len(symbols)
    if n == 0:
        return np.zeros(0, bool)
    rows = -(-n // chunk)
    s = np.full(rows * chunk, WORD, np.uint8)
    s[:n] = symbols
    s = s.reshape(rows, chunk)
    # every chunk as a function of its start state
    f = np.tile(np.arange(_STATES, dtype=np.uint8), (rows, 1))
    for c in range(chunk):
        f = _STEP[f, s[:, c : c + 1]]
    # inclusive scan: f[i] becomes the composition of chunks 0..i
    shift = 1
    while shift < rows:
        f[shift:] = np.take_along_axis(f[shift:], f[:-shift].copy(), 1)  # earlier first, then later
        shift *= 2
    state = np.r_[np.uint8(START), f[:-1, START]]
    out = np.zeros((rows, chunk), bool)
    for c in range(chunk):
        out[:, c] = _MARK[state, s[:, c]]
        state = _STEP[state, s[:, c]]
    return out.ravel()[:n]


# -- events -----------------------------------------------------------------------------------------------------
def _caseless(c: str) -> bool:
    return c.isalpha() and c.lower() == c.upper()


def _plain_lower(text: str, at: int) -> bool:
    """A word in small letters that is no code or file name begins here."""
    return text[at].islower() and not _CODE.search(_TOKEN.match(text, at)[0][:-1])


def _stop_ends(text: str, i: int, j: int, end: int) -> bool:
    """Whether the stop run text[i:j] ends a sentence that is not inside quotes or brackets."""
    k = _SPACES.match(text, j, end).end()
    if k >= end:
        return True
    c, spaced = text[k], k > j
    run = text[i:j]
    if not _HARD_STOPS.isdisjoint(run):
        return True
    if "!" in run or "?" in run:
        return (spaced and not _plain_lower(text, k)) or (not spaced and (c.isupper() or c in _OPENING or _caseless(c)))
    if len(run) > 1 or run == "…":
        if _caseless(c):
            return spaced and "…" not in run and not text.startswith(CONTINUATIONS, k)
        return (spaced or c.isupper()) and not _plain_lower(text, k) and c not in ",;:"
    word = _WORD_BEFORE.search(text, max(0, i - 24), i)[0]
    low = word.lower()
    if not spaced:
        if c.isupper():
            if len(word) < 2 or not (k + 1 < end and (text[k + 1].islower() or text[k + 1] in "'’ ")):
                return False
            return low in CLOSING_ABBREVIATIONS or (low not in ABBREVIATIONS and low not in NUMBER_ABBREVIATIONS and "." not in word)
        if c in _OPENING:
            return low not in ABBREVIATIONS and c not in "'‘"
        return _caseless(c) and bool(word) and _caseless(word[-1]) and low not in NUMBER_ABBREVIATIONS
    if c in ",;:":
        return False
    if low in CLOSING_ABBREVIATIONS:
        return not _plain_lower(text, k)
    if low in DEGREES:
        return _TOKEN.match(text, k)[0].rstrip(",;:.").lower() in SENTENCE_STARTS and not _plain_lower(text, k)
    if low in ABBREVIATIONS or (len(word) == 1 and word.isalpha() and not _caseless(word)):
        return False
    if low in NUMBER_ABBREVIATIONS and c.isdigit():
        return False
    if word.isdigit() and len(word) <= 2 and c.isupper():
        before = _WORD_BEFORE.search(text, max(0, i - 24), max(0, i - len(word) - 1))[0]
        if before.lower() in BEFORE_ORDINAL:
            return False
    return not _plain_lower(text, k)


def _close_kind(text: str, i: int, end: int) -> int:
    """0: the sentence goes on after the closing mark at ``i``; 1: it ends; 2: it ends if the quote began within it."""
    p = i - 1
    if p > 0 and text[p].isspace():
        p -= 1
    if p < 0 or text[p] not in _STOPS:
        return 0
    while p > 0 and (text[p] in _STOPS or text[p].isspace()):
        p -= 1
    k = _SPACES.match(text, i + 1, end).end()
    if k >= end:
        return 1
    c = text[k]
    if c in ",;:，、；：.!?。！？।؟と" or c in _CLOSE_QUOTES or c in _CLOSE_BRACKETS:
        return 0
    if _caseless(text[p]):
        return 2
    return 0 if _plain_lower(text, k) else 1


def _balanced(block: str) -> str:
    """The quote and bracket characters whose pairs are complete within the block."""
    ok = ""
    for o, c in ("«»", "「」", "『』", "‹›", "《》", "〈〉", "()", "[]", "{}", "（）", "【】", "［］"):
        if block.count(o) == block.count(c):
            ok += o + c
    if block.count('"') % 2 == 0:
        ok += '"'
    low, high, right = block.count("„"), block.count("“"), block.count("”")
    if (low and low == high + right) or (not low and high == right):
        ok += "„“”"
    return ok


def _block_events(text: str, start: int, end: int, pos: list[int], sym: list[int], until: int | None = None, usable: str | None = None) -> None:
    """Events of one paragraph, or of the part of it before ``until``, with the quotes and brackets that are ``usable`` in all of it."""
    last = start
    for m in _EVENT.finditer(text, start, end):
        i, j = m.span()
        if until is not None and i >= until:
            return
        c = text[i]
        if c in _STOPS:
            if _stop_ends(text, i, j, end):
                pos.append(j)
                sym.append(STOP)
                last = j
            continue
        if c.isspace():
            pos.append(j)
            sym.append(STOP)
            last = j
            continue
        if usable is None:
            usable = _balanced(text[start:end])
        if c not in usable:
            continue
        if c in _OPEN_QUOTES or c in _OPEN_BRACKETS or c in _EITHER:
            if _CONTENT.search(text, last, i):
                pos.append(i)
                sym.append(WORD)
        if c in _OPEN_QUOTES:
            symbol = OPEN_Q
        elif c in _CLOSE_QUOTES:
            symbol = CLOSE_Q + _close_kind(text, i, end)
        elif c in _EITHER:
            symbol = EITHER_Q + _close_kind(text, i, end)
        elif c in _OPEN_BRACKETS:
            symbol = OPEN_B
        else:
            symbol = CLOSE_B_END if _close_kind(text, i, end) else CLOSE_B
        pos.append(j)
        sym.append(symbol)
        last = j


def layout(text: str) -> Iterator[tuple[int, int, int]]:
    """The paragraphs of a text in order, each with the place of the break that ends it: (start, end, break)."""
    lines: list[tuple[int, int]] = []
    for m in _LINE.finditer(text):
        if m["dot"] and m.start() and not (lines and lines[-1][1] == m.start() - 1):
            before = text.rfind("\n", 0, m.start() - 1)
            if text[before + 1 : m.start() - 1].strip():
                continue  # a number with a dot amid wrapped prose is no list item
        lines.append(m.span())
    at = 0
    for a, b in [*lines, (len(text), len(text))]:
        for m in _BLANK.finditer(text, at, a):
            yield at, m.start(), m.end()
            at = m.end()
        yield at, a, a
        if b > a:
            yield b, b, b
        at = b


def events(text: str, pos: list[int], sym: list[int]) -> None:
    """Appends the events of a text: positions (where a unit would end) and symbols. The last is a BREAK."""
    for start, end, after in layout(text):
        _block_events(text, start, end, pos, sym)
        pos.append(after)
        sym.append(BREAK)


def split_texts(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, start, end) of the units of all texts."""
    pos: list[int] = []
    sym: list[int] = []
    owner_end: list[int] = []
    for t in texts:
        events(t, pos, sym)
        owner_end.append(len(pos))
    marks = np.flatnonzero(run_transducer(np.array(sym, np.uint8)))
    who = np.searchsorted(np.array(owner_end), marks, "right")
    cuts = np.array(pos, np.int64)[marks] if len(marks) else np.empty(0, np.int64)
    out: list[tuple[int, int, int]] = []
    previous, at, text = -1, 0, ""
    for d, cut in zip(who.tolist(), cuts.tolist(), strict=True):
        if d != previous:
            previous, at, text = d, 0, texts[d]
        if cut > at:
            piece = text[at:cut]
            left = len(piece) - len(piece.lstrip())
            body = piece.strip()
            if body:
                out.append((d, at + left, at + left + len(body)))
            at = cut
    a = np.array(out, np.int64).reshape(-1, 3)
    return a[:, 0], a[:, 1], a[:, 2]


# -- long documents, range by range -------------------------------------------------------------------------------------
#: Characters beyond a range that its rules can look at.
HALO = 4096


def _cut_place(text: str, at: int, end: int) -> int:
    """A place from ``at`` on, within a paragraph, where no mark is touched: after a letter or number, before one or a space."""
    while at < end and not (text[at - 1].isalnum() and (text[at].isalnum() or text[at].isspace())):
        at += 1
    return at


def ranges_of(text: str, range_chars: int) -> Iterator[tuple[int, int, list[tuple]]]:
    """(low, high, parts) of the ranges of a text. A part is (start, until, end, break, usable, begun): of the paragraph that ends at ``end``
    what lies before ``until``; ``break`` is -1 unless its end is in the range; ``usable`` is null unless the paragraph was cut; ``begun`` says
    that it began in a range before."""
    parts: list[tuple] = []
    low = 0
    for start, end, after in layout(text):
        usable = None
        while end - low > range_chars:
            place = _cut_place(text, max(start, low) + range_chars if start <= low else max(start + 1, low + range_chars), end)
            if place >= end:
                break
            usable = _balanced(text[start:end]) if usable is None else usable
            parts.append((max(start, low), place, end, -1, usable, low > start))
            yield low, place, parts
            parts, low = [], place
        parts.append((max(start, low), end, end, after, usable, low > start))
        if after - low > range_chars:
            yield low, after, parts
            parts, low = [], after
    if parts:
        yield low, len(text), parts


def range_events(body: str, base: int, parts: list[tuple]) -> tuple[np.ndarray, np.ndarray]:
    """(events, function) of a range. ``body`` is its text with the halo from ``base`` on. An event is (place, place without the
    white space before it, next place with content or -1, symbol)."""
    pos: list[int] = []
    sym: list[int] = []
    for start, until, end, after, usable, begun in parts:
        if begun:  # in a range before, which ends in a word
            pos.append(start - base)
            sym.append(WORD)
        _block_events(body, start - base, min(len(body), end - base), pos, sym, until - base, usable)
        if after >= 0:
            pos.append(after - base)
            sym.append(BREAK)
    out = np.empty((len(pos), 4), np.int64)
    for n, (p, q) in enumerate(zip(pos, sym, strict=True)):
        left = right = p
        while left > 0 and body[left - 1].isspace():
            left -= 1
        while right < len(body) and body[right].isspace():
            right += 1
        out[n] = p + base, left + base, right + base if right < len(body) else -1, q
    f = np.arange(_STATES, dtype=np.uint8)
    for q in sym:
        f = _STEP[f, q]
    return out, f


def _marked(events_: np.ndarray, state: int) -> np.ndarray:
    """The events after which a unit ends."""
    keep = np.zeros(len(events_), bool)
    for n, q in enumerate(events_[:, 3].tolist()):
        keep[n] = _MARK[state, q]
        state = _STEP[state, q]
    return events_[keep]


def _ranged_units(df: DataFrame, key: str, text: str, range_chars: int) -> DataFrame:
    """The units of long documents."""
    kind = df.schema[key].dataType.simpleString()

    def lay_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, t in enumerate(batch.column(1).to_pylist()):
                keys = batch.column(0).slice(row, 1)
                for n, (low, high, parts) in enumerate(ranges_of(t, range_chars)):
                    base = max(0, low - HALO)
                    lead = len(t[low:high]) - len(t[low:high].lstrip()) + low
                    columns = [
                        keys, pa.array([n], pa.int64()), pa.array([base], pa.int64()), pa.array([lead if lead < high else -1], pa.int64()),
                        pa.array([t[base : high + HALO]]), pa.array([json.dumps(parts)]),
                    ]
                    yield pa.RecordBatch.from_arrays(columns, names=[key, "n", "base", "lead", "body", "parts"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [range_events(b, base, json.loads(p)) for base, b, p in zip(*(batch.column(c).to_pylist() for c in ("base", "body", "parts")), strict=True)]
            columns = [batch.column(key), batch.column("n"), batch.column("lead"), pa.array([e.tobytes() for e, _ in made], pa.binary()), pa.array([f.tobytes() for _, f in made], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=[key, "n", "lead", "events", "f"])

    def compose(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("n")
        state, states = START, []
        for f in pdf["f"]:
            states.append(int(state))
            state = f[state]
        return pd.DataFrame({key: pdf[key], "n": pdf["n"], "state": states})

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cuts = [
                _marked(np.frombuffer(e, np.int64).reshape(-1, 4), s)[:, :3] for e, s in zip(batch.column("events").to_pylist(), batch.column("state").to_pylist(), strict=True)
            ]
            last = [int(c[-1, 2]) if len(c) else None for c in cuts]
            columns = [batch.column(key), batch.column("n"), batch.column("lead"), pa.array([c.tobytes() for c in cuts], pa.binary()), pa.array(last, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=[key, "n", "lead", "cuts", "last"])

    def carry(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("n")
        at, starts = -1, []  # -1: the next content begins the unit
        for lead, last in zip(pdf["lead"], pdf["last"], strict=True):
            at = int(lead) if at < 0 else at
            starts.append(at)
            if last == last and last is not None:
                at = int(last)
        return pd.DataFrame({key: pdf[key], "n": pdf["n"], "start": starts})

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, starts, ends = [], [], []
            for row, (blob, at) in enumerate(zip(batch.column("cuts").to_pylist(), batch.column("start").to_pylist(), strict=True)):
                c = np.frombuffer(blob, np.int64).reshape(-1, 3)
                begin = np.r_[at, c[:-1, 2]]
                ok = np.flatnonzero((begin >= 0) & (c[:, 1] > begin[: len(c)]) if len(c) else np.zeros(0, bool))
                rows += [row] * len(ok)
                starts += begin[ok].tolist()
                ends += c[ok, 1].tolist()
            yield pa.RecordBatch.from_arrays([batch.column(key).take(pa.array(rows, pa.int64())), pa.array(starts, pa.int64()), pa.array(ends, pa.int64())], names=[key, "start_idx", "end_idx"])

    k = f"`{key}` {kind}"
    laid = df.select(key, text).mapInArrow(lay_out, f"{k}, n long, base long, lead long, body string, parts string")
    met = stored(laid.repartition(shuffle_width(df), key, "n").mapInArrow(meet, f"{k}, n long, lead long, events binary, f binary"), "events")
    states = met.select(key, "n", "f").groupBy(key).applyInPandas(compose, f"{k}, n long, state int")  # ten bytes a range
    cut = stored(met.join(states, [key, "n"]).mapInArrow(mark, f"{k}, n long, lead long, cuts binary, last long"), "cuts")
    starts = cut.select(key, "n", "lead", "last").groupBy(key).applyInPandas(carry, f"{k}, n long, start long")
    return cut.join(starts, [key, "n"]).mapInArrow(emit, f"{k}, start_idx long, end_idx long")


def sentence_units(df: DataFrame, key: str = "doc_id", text: str = "text", batch_chars: int = 4_000_000, range_chars: int = 1_000_000) -> DataFrame:
    """(key, start_idx, end_idx), one row a unit. Documents are independent, so nothing is shuffled but those longer than ``range_chars`` and
    their ranges. Repeated rows give their units again."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            lo = 0
            while lo < len(texts):
                hi, size = lo, 0
                while hi < len(texts) and (hi == lo or size < batch_chars):
                    size += len(texts[hi] or "")
                    hi += 1
                who, start, end = split_texts([t or "" for t in texts[lo:hi]])
                keys = batch.column(0).take(pa.array(who + lo))
                yield pa.RecordBatch.from_arrays([keys, pa.array(start), pa.array(end)], names=[key, "start_idx", "end_idx"])
                lo = hi

    size = F.length(text)
    units = df.where(F.coalesce(size, F.lit(0)) <= range_chars).select(key, text).mapInArrow(run, f"`{key}` {kind}, start_idx long, end_idx long")
    long = df.where(size > range_chars).select(F.col(key).alias("_key"), F.col(text).alias("_text"), F.xxhash64(text).alias("_h"))
    if long.isEmpty():
        return units
    once = long.groupBy("_key", "_h").agg(F.first("_text").alias("_text"), F.count(F.lit(1)).cast("int").alias("_times"))
    once = stored(once.withColumn("_k", F.concat_ws("#", F.col("_key").cast("string"), "_h")), "long")
    found = _ranged_units(once, "_k", "_text", range_chars)
    repeated = found.join(once.select("_k", "_key", "_times"), "_k").withColumn("_t", F.explode(F.sequence(F.lit(1), F.col("_times"))))
    return units.unionByName(repeated.select(F.col("_key").alias(key), "start_idx", "end_idx"))
