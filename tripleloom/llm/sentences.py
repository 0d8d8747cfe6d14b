"""Sentence boundaries across languages and scripts, by a finite transducer run as a prefix scan.

Boundary rules are compiled into events (marks, quotes, paragraph breaks) and two machines over them. One reads from
the right; its state is the set of quotations that still close in the paragraph, which tells an opening sign from a
stray one. The other reads from the left; its state is the open quotation, and it emits the boundaries. A piece of
text is a function from the state before it to the state after it, for either machine. Pieces of long documents are
rows of their own, worked on by any task; their functions are composed by a scan over (document, piece), and each
piece then replays from the state that it is entered in. Short texts take the same steps in blocks of one batch.
Offsets are code points.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import cut
from ..sources.tables import table
from .lookalike import CYRILLIC, GREEK, INVISIBLE, char_class

# Abbreviations after which a sentence goes on (lower case, without the last point).
GOES_ON = {
    "en": "dr prof st mr mrs ms messrs rev gen col lt capt sgt vs e.g i.e cf viz sq approx",
    "fr": "mme mmes mlle mm dr pr env ex",
    "de": "dr prof bzw z u ca mio mrd hr fr evtl ggf sog inkl",
    "es": "sr sra sres srta dr dra ee ud uds d",
    "ru": "проф акад ул г гг см т е млн млрд тыс им рис",
    "hi": "डॉ प्रो श्री श्रीमती",
}
# Abbreviations that belong to a number after them.
BEFORE_NUMBER = {
    "en": "no nos fig figs sec secs ch vol pp p art eq tab",
    "fr": "t p pp vol chap art fig n",
    "de": "nr bd s abb kap art",
    "es": "pág págs cap vol núm art",
    "ru": "рис стр гл табл",
}
# Words that a German ordinal number stands before.
AFTER_ORDINAL = (
    "Januar Jänner Februar März April Mai Juni Juli August September Oktober November Dezember Jahrhundert Jahrhunderts Jahrtausend Auflage Kapitel"
)

MARKS = ".!?…"
CJK_MARKS = "。！？｡"
STOPS = "।॥۔؟"
OPENERS = "«„“「『‹‘([{¿¡（【《〈"
#: Quotation kinds: (opening, closing) signs; the sixth is the straight quote, which opens and closes.
KINDS = (("„", "“”"), ("“", "”"), ("«", "»"), ("「", "」"), ("『", "』"), ('"', '"'))
N_KINDS = len(KINDS)
BLOCK = 64
#: Documents of more code points are cut into pieces of about so many.
PIECE = 1 << 16
#: Code points around a piece that its rules may look at. Pieces are cut inside words, so that no sign or blank at a
#: border belongs to two of them, and the rules look no further than one word on either side.
MARGIN = 64

_SAME = {ord(k): v for t in (CYRILLIC, GREEK) for k, v in t.items()}
_ASCII = {0xFF01 + i: chr(0x21 + i) for i in range(94) if chr(0x21 + i).isalnum() or chr(0x21 + i) in '."\'('} | {0x2010: "-", 0x2011: "-"}
_GONE = re.compile(char_class(INVISIBLE))
_WIDE = re.compile("[＂＇（．０-９Ａ-Ｚａ-ｚ\u2010\u2011]")


def _skeleton(word: str) -> str:
    return unicodedata.normalize("NFC", word).translate(_SAME).lower()


_GOES_ON = frozenset(_skeleton(w) for ws in GOES_ON.values() for w in ws.split())
_AFTER_ORDINAL = frozenset(map(_skeleton, AFTER_ORDINAL.split()))
_BEFORE_NUMBER = frozenset(_skeleton(w) for ws in BEFORE_NUMBER.values() for w in ws.split())

_THAI = "ก-๛"
_CLOSERS = "\"'”’»」』)\\]）】》〉"
_EVENT = re.compile(
    rf"(?P<para>[^\S\n]*\n[^\S\n]*\n\s*)"
    rf"|(?P<mark>(?:[{CJK_MARKS}]+|[{MARKS}{STOPS}]+)(?:[{_CLOSERS}]|[^\S\n]»)*)"
    rf"|(?P<quote>[\"„“”«»「」『』])"
    rf"|(?<=[{_THAI}\"”])(?P<thai>\s+)(?=[{_THAI}\"“])"
)
_LAST_WORD = re.compile(r"[^\s()\"'«»„“”\[\]*]+$")
_NEXT_WORD = re.compile(r"\s*(\w+)")
_INITIALS = re.compile(r"^(?:[^\W\d_]\.?-)*[^\W\d_]$")


# ---- the transducer -------------------------------------------------------------------------------

#: States: 0 outside a quotation; 1 + 2 k + s inside kind k, s = 1 if it opened at a sentence start.
N_STATES = 1 + 2 * N_KINDS
B, P = 0, 1  # a boundary unless quoted; a boundary that also ends any quotation
_OPEN, _CLOSE, _CLOSE_END, _CLOSE_CJK, _TOGGLE = (2, 2 + 2 * N_KINDS, 2 + 3 * N_KINDS, 2 + 4 * N_KINDS, 2 + 5 * N_KINDS)
_LOW9, _LOW9_END = _TOGGLE + 2, _TOGGLE + 4  # the sign that closes a low quotation and opens a high one
N_EVENTS = _LOW9_END + 2
# what the left machine reads in place of signs that nothing closes: those that then can only close, and no event
_LOW_ONLY, _LOW_ONLY_END, _NOTHING = N_EVENTS, N_EVENTS + 1, N_EVENTS + 2
N_CLASSES = _NOTHING + 1


def _compile() -> tuple[np.ndarray, np.ndarray]:
    """(next state, emits a boundary) by event class and state."""
    to = np.tile(np.arange(N_STATES, dtype=np.uint8), (N_CLASSES, 1))
    out = np.zeros((N_CLASSES, N_STATES), bool)
    out[B, 0] = True
    to[P], out[P] = 0, True
    for k in range(N_KINDS):
        mid, start = 1 + 2 * k, 2 + 2 * k
        for s in (0, 1):
            to[_OPEN + 2 * k + s, 0] = 1 + 2 * k + s
        for c in (_CLOSE, _CLOSE_END, _CLOSE_CJK):
            to[c + k, [mid, start]] = 0
        out[_CLOSE_END + k, [0, mid, start]] = True
        out[_CLOSE_CJK + k, [0, mid]] = True
    straight = 1 + 2 * (N_KINDS - 1)
    for s in (0, 1):
        to[_TOGGLE + s, 0] = straight + s
        to[_TOGGLE + s, [straight, straight + 1]] = 0
        for c in (_LOW9, _LOW9_END):
            to[c + s, 0] = 1 + 2 * 1 + s
            to[c + s, [1, 2]] = 0
        out[_LOW9_END + s, [1, 2]] = True
    for c in (_LOW_ONLY, _LOW_ONLY_END):
        to[c, [1, 2]] = 0
    out[_LOW_ONLY_END, [1, 2]] = True
    return to, out


def _compile_right() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the right machine: (kinds that an event class closes, kind that must close for it to open, class if none does)."""
    closes = np.zeros((N_EVENTS, N_KINDS), bool)
    needs, instead = np.full(N_EVENTS, -1), np.arange(N_EVENTS)
    for k in range(N_KINDS):
        closes[[_CLOSE + k, _CLOSE_END + k, _CLOSE_CJK + k], k] = True
        needs[[_OPEN + 2 * k, _OPEN + 2 * k + 1]], instead[[_OPEN + 2 * k, _OPEN + 2 * k + 1]] = k, _NOTHING
    for s in (0, 1):
        closes[[_LOW9 + s, _LOW9_END + s], 0] = True
        closes[_TOGGLE + s, N_KINDS - 1] = True
        needs[[_LOW9 + s, _LOW9_END + s, _TOGGLE + s]] = 1, 1, N_KINDS - 1
        instead[[_LOW9 + s, _LOW9_END + s, _TOGGLE + s]] = _LOW_ONLY, _LOW_ONLY_END, _CLOSE + N_KINDS - 1
    return closes, needs, instead


_TO, _OUT = _compile()
_CLOSES, _NEEDS, _INSTEAD = _compile_right()


def right_function(events: np.ndarray) -> tuple[bool, int]:
    """(whether the kinds that close to the right of the piece still do so, kinds that close in it) before its first event."""
    paras = np.flatnonzero(events == P)
    head = events[: paras[0]] if len(paras) else events
    return len(paras) == 0, int((_CLOSES[head].any(0) << np.arange(N_KINDS)).sum()) if len(head) else 0


def resolved(events: np.ndarray, closing: int = 0) -> np.ndarray:
    """Classes for the left machine: signs that nothing closes in their paragraph open nothing.

    `closing` has the kinds that close to the right of the events, before a paragraph ends.
    """
    n = len(events)
    at = np.arange(n)
    paras = np.append(at[events == P], n)
    para = paras[np.searchsorted(paras, at, side="right")]
    out = events.copy()
    for k in range(N_KINDS):
        asks = np.flatnonzero(_NEEDS[events] == k)
        if len(asks):
            # a place after the last event stands for what closes further right
            shut = np.append(at[_CLOSES[events, k]], n if closing >> k & 1 else n + 1)
            first = shut[np.searchsorted(shut, asks, side="right")]
            stray = asks[(first > para[asks]) | (first == para[asks]) & (first < n)]
            out[stray] = _INSTEAD[events[stray]]
    return out


def compose(functions: np.ndarray) -> np.ndarray:
    """Prefix compositions of state functions (n, states), in log2(n) steps."""
    step = 1
    while step < len(functions):
        after = functions.copy()
        after[step:] = np.take_along_axis(functions[step:], functions[:-step], axis=1)
        functions, step = after, step * 2
    return functions


def _grid(classes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(classes in rows of BLOCK, state function of each row); all rows step side by side through all states."""
    blocks = -(-len(classes) // BLOCK)
    padded = np.full(blocks * BLOCK, _NOTHING, np.int64)
    padded[: len(classes)] = classes
    grid = padded.reshape(blocks, BLOCK)
    whole = np.tile(np.arange(N_STATES, dtype=np.uint8), (blocks, 1))
    for j in range(BLOCK):
        whole = _TO[grid[:, j, None], whole]
    return grid, whole


def left_function(classes: np.ndarray) -> np.ndarray:
    """State after the classes, for each state before them."""
    if not len(classes):
        return np.arange(N_STATES, dtype=np.uint8)
    return compose(_grid(classes)[1])[-1]


def scan(classes: np.ndarray, entry: int = 0) -> np.ndarray:
    """Whether each class of a stream that is entered in a state emits a boundary.

    The functions of the blocks are composed by a prefix scan, and a second pass replays each block from its entry state.
    """
    if not len(classes):
        return np.zeros(0, bool)
    grid, whole = _grid(classes)
    state = np.full(len(grid), entry, np.uint8)
    state[1:] = compose(whole)[:-1, entry]
    emits = np.zeros(grid.shape, bool)
    for j in range(BLOCK):
        emits[:, j] = _OUT[grid[:, j], state]
        state = _TO[grid[:, j], state]
    return emits.reshape(-1)[: len(classes)]


# ---- events ---------------------------------------------------------------------------------------


def _begins(t: str, at: int, gap_needed: bool) -> bool:
    """Whether what stands at `at`, after blanks, can begin a sentence."""
    n, k = len(t), at
    while k < n and t[k].isspace():
        k += 1
    gap = k > at
    while k < n and t[k] in "*_":
        k += 1
    if k == n:
        return True
    ch = t[k]
    if ch.isupper():
        return True
    if ch.islower():
        return gap and k + 1 < n and t[k + 1].isupper()
    if ch.isalpha():
        return gap or not gap_needed
    if ch.isdigit():
        return gap or not gap_needed
    if ch in OPENERS:
        return True
    if ch in "\"'#•-–—":
        return gap and not (ch in "-–—" and k + 1 < n and t[k + 1].isspace())
    if unicodedata.category(ch)[0] in "PM":
        return False
    return gap


#: No rule accepts a longer word before a point, even with its accents written apart.
REACH = 2 * max(map(len, _GOES_ON | _BEFORE_NUMBER)) + 8


def _goes_on(t: str, at: int) -> bool:
    """Whether the point at `at` belongs to an abbreviation, initial or ordinal that the sentence continues after."""
    m = _LAST_WORD.search(t, max(0, at - REACH), at)
    if not m:
        return False
    raw = m.group()
    head, _, tail = raw.rpartition(".")
    if len(head.rpartition(".")[2]) > 2:
        raw = tail  # a sentence before it ended without a blank
    word = _skeleton(raw)
    if word in _GOES_ON:
        return True
    bare = unicodedata.normalize("NFC", raw)
    if _INITIALS.match(bare) and bare[-1].isupper():
        return True
    nxt = _NEXT_WORD.match(t, at + 1)
    if nxt is None:
        return False
    if word in _BEFORE_NUMBER:
        return nxt.group(1)[0].isdigit()
    if raw.isdigit() and len(raw) <= 2:
        return _skeleton(nxt.group(1)) in _AFTER_ORDINAL
    return False


def _opens_at_start(t: str, at: int) -> bool:
    k = at - 1
    while k >= 0 and t[k].isspace():
        k -= 1
    return k < 0 or t[k] in MARKS or t[k] in CJK_MARKS or t[k] in STOPS or t[k] in "”»」』\""


_KIND_OF_OPENER = {o: k for k, (o, _) in enumerate(KINDS)}
_KIND_OF_CLOSER = {"”": 1, "»": 2, "」": 3, "』": 4, '"': 5}


def _events(t: str, pos: list[int], cls: list[int], low: int = 0, high: int | None = None) -> None:
    """Appends the end offset and class of every event of t that begins in [low, high); a text has its heading at 0."""
    n, heading = len(t), False
    high = n if high is None else high
    first = t.find("\n", n - len(t.lstrip())) if low == 0 else -1
    if 0 < first < high:
        line = t[:first].strip()
        rest = first
        while rest < n and t[rest].isspace():
            rest += 1
        ends = line[-1:] and (line[-1] in MARKS or line[-1] in CJK_MARKS or line[-1] in STOPS or line.rstrip("\"'”’»」』)）")[-1:] in tuple(MARKS + CJK_MARKS + STOPS))
        heading = bool(line and not ends and rest < n and not t[rest].islower())
    begun = len(pos)
    for m in _EVENT.finditer(t):
        kind, s, e = m.lastgroup, m.start(), m.end()
        if s < low:
            continue
        if s >= high:
            break
        if kind == "para":
            pos.append(s)
            cls.append(P)
        elif kind == "thai":
            pos.append(s)
            cls.append(B)
        elif kind == "quote":
            ch = t[s]
            if ch == '"':
                left = s == 0 or t[s - 1].isspace() or t[s - 1] in "([（"
                right = e == n or t[e].isspace() or t[e] in ",;:.!?)]—-"
                pos.append(e)
                if left and not right:
                    cls.append(_OPEN + 2 * 5 + _opens_at_start(t, s))
                elif right and not left:
                    cls.append(_CLOSE + 5)
                else:
                    cls.append(_TOGGLE + _opens_at_start(t, s))
            elif ch == "“":
                after_mark = s > 0 and (t[s - 1] in MARKS or t[s - 1] in STOPS)
                pos.append(e)
                cls.append((_LOW9_END if after_mark and _begins(t, e, True) and e < n and t[e].isspace() else _LOW9) + _opens_at_start(t, s))
            elif ch in _KIND_OF_OPENER:
                pos.append(s)
                cls.append(_OPEN + 2 * _KIND_OF_OPENER[ch] + _opens_at_start(t, s))
            else:
                pos.append(e)
                cls.append(_CLOSE + _KIND_OF_CLOSER[ch])
        else:
            _mark(t, s, e, pos, cls)
    if heading:
        # a first line that holds a boundary of its own is no heading
        at = begun
        while at < len(pos) and pos[at] < first:
            heading &= cls[at] not in (B, P)
            at += 1
        if heading:
            pos.insert(at, first)
            cls.insert(at, P)


def _mark(t: str, s: int, e: int, pos: list[int], cls: list[int]) -> None:
    n, stop = len(t), s
    while stop < e and (t[stop] in MARKS or t[stop] in CJK_MARKS or t[stop] in STOPS):
        stop += 1
    body, tail = t[s:stop], t[stop:e]
    cjk, ellipsis = body[0] in CJK_MARKS, body[0] == "…" or body.startswith("..")
    if tail.startswith('"') and e < n and not t[e].isspace() and (t[e].isalnum()) and not cjk:
        # no blank after the sign: it closes an open quotation, or else opens the next sentence
        if _point_ends(t, s, body, stop, e - len(tail), ellipsis, cjk):
            pos.append(stop)
            cls.append(B)
        pos.append(stop + 1)
        cls.append(_TOGGLE + 1)
        return
    quote = next((ch for ch in tail if ch in _KIND_OF_CLOSER), None)
    ends = _point_ends(t, s, body, stop, e, ellipsis, cjk)
    if quote is None:
        if ends:
            pos.append(e)
            cls.append(B)
        return
    k = _KIND_OF_CLOSER[quote]
    if k == 1 and not cjk:
        # the high sign also closes a low quotation
        pos.append(e)
        cls.append(_CLOSE + 0)
    pos.append(e)
    if cjk or (k in (3, 4)):
        nxt = t[e : e + 1]
        if nxt in OPENERS and nxt:
            cls.append(_CLOSE_END + k)
        elif nxt and nxt in "と、，。って；：":
            cls.append(_CLOSE + k)
        else:
            cls.append(_CLOSE_CJK + k)
    else:
        cls.append((_CLOSE_END if ends else _CLOSE) + k)


def _point_ends(t: str, s: int, body: str, stop: int, e: int, ellipsis: bool, cjk: bool) -> bool:
    n = len(t)
    if cjk:
        k = e
        while k < n and t[k].isspace():
            k += 1
        return not (k > e and k < n and t[k].islower())
    if body[0] == "…" and s > 0 and not t[s - 1].isascii() and unicodedata.east_asian_width(t[s - 1]) in "WF":
        return e == n
    if body[0] in STOPS:
        return True
    spaced = s > 0 and t[s - 1].isspace()
    if ellipsis:
        return not spaced and _begins(t, e, True) or e == n
    if not _begins(t, e, body == "."):
        return False
    if body != "." or spaced:
        return True
    if e < n and not t[e].isspace():
        # no blank after the point: only between a word or number and a capital
        k = s - 1
        if not (t[e].isupper() or t[e] in "«„“¿¡") or k < 1 or not (t[k].isdigit() or t[k] in ")\"”" or (t[k].islower() and t[k - 1].islower())):
            return False
    return not (stop == e and _goes_on(t, s))


def _plain(t: str) -> tuple[str, list[int] | None]:
    """The text that the rules see, without invisible signs and in ASCII where that looks the same, and where its characters stood."""
    back = None
    if not t.isascii():
        if _GONE.search(t):
            back = [i for i, ch in enumerate(t) if ch not in _HIDDEN]
            t = _GONE.sub("", t)
        if _WIDE.search(t):
            t = t.translate(_ASCII)
    return t, back


def segment(texts: Sequence[str | None]) -> list[list[tuple[int, int]]]:
    """(start, end) code-point offsets of the sentences of each text; null and blank texts have none."""
    plain = [_plain(t or "") for t in texts]
    pos: list[int] = []
    cls: list[int] = []
    owner: list[tuple[int, int]] = []
    for t, _ in plain:
        a = len(pos)
        # a paragraph event before each text puts both machines back outside
        pos.append(0)
        cls.append(P)
        _events(t, pos, cls)
        owner.append((a, len(pos)))
    cl, ps = np.array(cls, np.int64), np.array(pos, np.int64)
    emits = scan(resolved(cl))
    found = []
    for (t, back), (a, b) in zip(plain, owner):
        ends = ps[a:b][emits[a:b]].tolist()
        ends.append(len(t))
        spans, at, n = [], 0, len(t)
        for e in ends:
            if e < at:
                continue
            while at < e and t[at].isspace():
                at += 1
            z = e
            while z > at and t[z - 1].isspace():
                z -= 1
            if z > at:
                spans.append((at, z) if back is None else (back[at], back[z - 1] + 1))
            at = e
        found.append(spans)
    return found


_HIDDEN = frozenset(INVISIBLE)


# ---- documents in pieces --------------------------------------------------------------------------


def borders(t: str, size: int) -> list[int]:
    """Starts of the pieces of a text: about every `size` code points, always inside a word; the first line stays whole."""
    out, at = [0], max(size, t.find("\n", len(t) - len(t.lstrip())) + 1)
    while at < len(t):
        if t[at - 1].isalnum() and t[at].isalnum():
            out.append(at)
            at += size
        else:
            at += 1
    return out


def _with_margin(t: str, low: int, high: int) -> tuple[int, int]:
    """Start and end of what the rules of a piece may look at: MARGIN visible code points on either side."""
    left, need = low, MARGIN
    while left > 0 and need:
        left -= 1
        need -= t[left] not in _HIDDEN
    right, need = high, MARGIN
    while right < len(t) and need:
        need -= t[right] not in _HIDDEN
        right += 1
    return left, right


def piece_events(t: str, low: int, high: int, first: bool, last: bool) -> tuple[list[int], ...]:
    """(classes, places, ends, starts) of the events of a piece [low, high) of a text with its margins.

    `ends` is where a sentence ends that the event closes, `starts` where the next one begins, blanks left out. The
    last piece closes with a paragraph event.
    """
    plain, back = _plain(t)
    where = lambda i: i if back is None else back[i] if i < len(back) else len(t)
    lo, hi = (low, high) if back is None else (bisect_left(back, low), bisect_left(back, high))
    pos: list[int] = []
    cls: list[int] = []
    _events(plain, pos, cls, 0 if first else max(lo, 1), hi)
    if last:
        pos.append(len(plain))
        cls.append(P)
    ends, starts = [], []
    for e in pos:
        z = e
        while z > 0 and plain[z - 1].isspace():
            z -= 1
        while e < len(plain) and plain[e].isspace():
            e += 1
        ends.append(where(z - 1) + 1 if z else 0)
        starts.append(where(e))
    return cls, [where(e) for e in pos], ends, starts


def _in_pieces(docs: DataFrame, kind: str, size: int, with_text: bool) -> DataFrame:
    """(id, sent_no, sent_start, sent_end[, sentence]) of documents (id, t), each in pieces that are rows of their own.

    Only the state functions of the pieces, a few bytes each, come together by document.
    """

    def dealt(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for id_, t in zip(batch["id"].tolist(), batch["t"]):
                at = borders(t, size)
                for k, (low, high) in enumerate(zip(at, [*at[1:], len(t)])):
                    left, right = _with_margin(t, low, high)
                    yield pd.DataFrame({"id": [id_], "piece": [k], "base": [left], "low": [low], "high": [high], "last": [high == len(t)], "t": [t[left:right]]})

    def read(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for id_, k, base, low, high, last, t in batch[["id", "piece", "base", "low", "high", "last", "t"]].itertuples(index=False):
                cls, pos, ends, starts = piece_events(t, low - base, high - base, k == 0, last)
                keep, adds = right_function(np.array(cls, np.int64))
                lead = next((base + i for i, ch in enumerate(t) if not (ch.isspace() or ch in _HIDDEN)), high) if k == 0 else None
                own = t[low - base : high - base] if with_text else None
                rows.append((id_, k, low, keep, adds, lead, cls, [base + x for x in pos], [base + x for x in ends], [base + x for x in starts], own))
            if rows:
                out = pd.DataFrame(rows, columns=["id", "piece", "low", "keep", "adds", "lead", "cls", "pos", "ends", "starts", "own"])
                yield out.astype({"lead": "Int64"})

    pieces = docs.mapInPandas(dealt, f"id {kind}, piece bigint, base bigint, low bigint, high bigint, last boolean, t string").repartition("id", "piece")
    schema = f"id {kind}, piece bigint, low bigint, keep boolean, adds int, lead bigint, cls array<int>, pos array<bigint>, ends array<bigint>, starts array<bigint>, own string"
    events = cut(pieces.mapInPandas(read, schema))

    def from_right(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("piece", ascending=False)
        closing, entered = 0, []
        for keep, adds in zip(pdf["keep"], pdf["adds"]):
            entered.append(closing)
            closing = (closing if keep else 0) | int(adds)
        return pd.DataFrame({"id": pdf["id"], "piece": pdf["piece"], "closing": entered})

    closing = events.select("id", "piece", "keep", "adds").groupBy("id").applyInPandas(from_right, f"id {kind}, piece bigint, closing int")
    entered = cut(events.join(closing, ["id", "piece"]))

    def functions(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            f = [left_function(resolved(np.array(c, np.int64), k)).tolist() for c, k in zip(batch["cls"], batch["closing"])]
            yield pd.DataFrame({"id": batch["id"], "piece": batch["piece"], "f": f})

    def from_left(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("piece")
        after = compose(np.array(pdf["f"].tolist(), np.uint8))[:, 0]
        return pd.DataFrame({"id": pdf["id"], "piece": pdf["piece"], "state": np.append(0, after[:-1]).astype(np.int32)})

    states = entered.select("id", "piece", "cls", "closing").mapInPandas(functions, f"id {kind}, piece bigint, f array<int>")
    states = states.groupBy("id").applyInPandas(from_left, f"id {kind}, piece bigint, state int")

    def bounds(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for r in batch.itertuples(index=False):
                emits = np.flatnonzero(scan(resolved(np.array(r.cls, np.int64), r.closing), r.state))
                at, kept = -1, []
                for i in emits.tolist():
                    if r.pos[i] >= at:
                        kept.append(i)
                        at = r.pos[i]
                rows.append((r.id, r.piece, r.low, r.lead, [r.ends[i] for i in kept], [r.starts[i] for i in kept], r.own))
            if rows:
                yield pd.DataFrame(rows, columns=["id", "piece", "low", "lead", "ends", "starts", "own"]).astype({"lead": "Int64"})

    found = entered.join(states, ["id", "piece"]).mapInPandas(bounds, f"id {kind}, piece bigint, low bigint, lead bigint, ends array<bigint>, starts array<bigint>, own string")
    found = cut(found)
    # what a piece hands on: where the sentence begins that is open at its end, and how many it closed
    before = Window.partitionBy("id").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    hand = found.select("id", "piece", "ends", "starts", F.coalesce(F.last(F.try_element_at("starts", F.lit(-1)), True).over(before), F.first("lead", True).over(Window.partitionBy("id"))).alias("open"))
    begins = F.concat(F.array("open"), F.slice("starts", 1, F.greatest(F.size("starts") - 1, F.lit(0))))
    spans = F.filter(F.arrays_zip(begins.alias("b"), F.col("ends").alias("e")), lambda x: x["e"] > x["b"])
    hand = hand.withColumn("spans", F.when(F.size("ends") > 0, spans).otherwise(F.array().cast("array<struct<b:bigint,e:bigint>>")))
    hand = hand.withColumn("done", F.coalesce(F.sum(F.size("spans")).over(before), F.lit(0)))
    rows = hand.select("id", F.col("done"), F.posexplode("spans").alias("k", "s"))
    rows = rows.select("id", (F.col("done") + F.col("k")).cast("int").alias("sent_no"), F.col("s.b").alias("sent_start"), F.col("s.e").alias("sent_end"))
    if not with_text:
        return rows
    # parts of sentences that pieces hold, those of a sentence over several pieces joined
    last = F.coalesce(F.try_element_at("starts", F.lit(-1)), F.col("open"))
    held = F.concat("spans", F.array(F.struct(last.alias("b"), (F.col("low") + F.length("own")).alias("e"))))
    parts = hand.select("id", "piece", "done", "open", "starts", "spans").join(found.select("id", "piece", "low", "own"), ["id", "piece"]).select("id", "piece", "low", "own", "done", F.posexplode(held).alias("k", "s"))
    text = F.substring("own", (F.greatest("s.b", "low") - F.col("low") + 1).cast("int"), F.greatest(F.col("s.e") - F.greatest("s.b", "low"), F.lit(0)).cast("int"))
    parts = parts.select("id", (F.col("done") + F.col("k")).cast("int").alias("sent_no"), "piece", text.alias("part"))
    joined = parts.groupBy("id", "sent_no").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("piece", "part"))), lambda x: x["part"]), "").alias("text"))
    rows = rows.join(joined, ["id", "sent_no"])
    return rows.select("id", "sent_no", "sent_start", "sent_end", F.substring("text", F.lit(1), (F.col("sent_end") - F.col("sent_start")).cast("int")).alias("sentence"))


def sentences(docs: DataFrame, id_col: str = "doc_id", text: str = "text", with_text: bool = False, piece: int = PIECE) -> DataFrame:
    """(id, sent_no, sent_start, sent_end[, sentence]) for every text, in order; offsets are code points.

    Texts of more than `piece` code points are worked on in pieces by many tasks; the result is the same. Null, empty
    and blank texts give no row; repeated rows of short texts give repeated rows, an identifier must name one long text
    (its copies count once); other columns are ignored.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, sent_no int, sent_start bigint, sent_end bigint" + ", sentence string" * with_text

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            spans = segment(batch["t"])
            sizes = np.fromiter(map(len, spans), np.int64, len(spans))
            flat = np.array([x for s in spans for x in s], np.int64).reshape(-1, 2)
            out = {
                "id": batch["id"].to_numpy().repeat(sizes),
                "sent_no": np.concatenate([np.arange(k) for k in sizes]).astype(np.int32) if len(flat) else np.zeros(0, np.int32),
                "sent_start": flat[:, 0],
                "sent_end": flat[:, 1],
            }
            if with_text:
                out["sentence"] = [t[a:b] for t, s in zip(batch["t"], spans) for a, b in s]
            if len(flat):
                yield pd.DataFrame(out)

    rows = docs.select(F.col(id_col).alias("id"), F.col(text).alias("t")).where("id is not null and t is not null")
    short = rows.where(F.length("t") <= piece).mapInPandas(run, schema)
    long = rows.where(F.length("t") > piece)
    if long.isEmpty():
        return short
    return short.unionByName(_in_pieces(long.dropDuplicates(["id"]), kind, piece, with_text))


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return sentences(table(spark, folder, "documents")).select(F.col("id").alias("doc_id"), "sent_start", "sent_end")


def p3_lengths(spark: SparkSession, folder: str) -> DataFrame:
    """Per document: sentences, and the shortest and longest in code points."""
    size = F.col("sent_end") - F.col("sent_start")
    return sentences(table(spark, folder, "documents")).groupBy(F.col("id").alias("doc_id")).agg(F.count("*").alias("n_sentences"), F.min(size).alias("shortest"), F.max(size).alias("longest"))


def p3_letters(spark: SparkSession, folder: str) -> DataFrame:
    """Letters and digits of each document that stand in its sentences: all of them, each once."""
    seen = sentences(table(spark, folder, "documents"), with_text=True).select(F.col("id").alias("doc_id"), F.length(F.regexp_replace("sentence", r"[^\p{L}\p{N}]+", "")).cast("bigint").alias("n"))
    return seen.groupBy("doc_id").agg(F.sum("n").alias("n_letters"))


QUERIES = {"p3_found": p3_found, "p3_lengths": p3_lengths, "p3_letters": p3_letters}
ORACLE = {"p3_letters": "SELECT doc_id, length(regexp_replace(text, '[^\\p{L}\\p{N}]+', '', 'g')) AS n_letters FROM documents WHERE trim(text, ' ' || chr(9) || chr(10)) <> ''"}
