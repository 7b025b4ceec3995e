"""Personal data in texts: exact patterns for usual forms, and a character tagger for those that the patterns miss.

The tagger is a bidirectional LSTM with CRF transitions (``sequence_tagger``), trained in numpy on the driver from labelled spans:
windows of a bounded sample of the documents, in which the patterns' own finds are labelled, and into which spans of each kind are
written in usual and unusual forms (an address with "at" and "dot" in words, a number without its plus sign, a card number parted by
dots), beside numbers, dates, versions and keys that are none. Every text is tagged whole, in windows that overlap. Each window is
decoded on its own; the spans of all windows of a text are reconciled by the best set that does not overlap, and what meets a span of
the patterns, is not certain enough, or has too few or too many digits for its kind is left out.

Edge cases: a null text is empty and has no span; a doc_id may be null or repeated, rows are judged one by one; without any text to
train on, or with none that holds a letter or digit, only the patterns find spans; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import random
import re
from bisect import bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .sequence_tagger import Tagger
from .shared import tidy
from .token_ids import slices
from .words import slices_of

KINDS = ("email", "ip", "card", "phone")

#: The classifier is fitted on windows of so many characters from so many documents at most, chosen by hash.
SAMPLE_DOCUMENTS, SAMPLE_LENGTH = 400, 600
TRAIN_WINDOWS, TRAIN_LENGTH, TRAIN_ROUNDS, TRAIN_BATCH, WIDTH, SEED = 2_400, 96, 8, 48, 10, 20
#: Characters of a window, and how many of them the next one repeats: no span of the tagger is longer than that.
WINDOW, OVERLAP, ROWS = 512, 64, 512
#: How much likelier than no span at all a tagged span must be, in nats.
CERTAIN = 3.0

_HOST = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_NO_DIGIT = re.compile(r"[^0-9]+")


def luhn(digits: str) -> bool:
    """Whether a number's last digit is its check digit."""
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def _emails(text: str):
    """As the pattern finds them from the left: the longest local part before each sign that a host with a dot follows."""
    end, at = 0, text.find("@")
    while at >= 0:
        host = _HOST.match(text, at + 1)
        if host:
            start = at
            while start > end and text[start - 1] in _LOCAL:
                start -= 1
            if start < at:
                end = host.end()
                yield start, end
        at = text.find("@", at + 1)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the exact patterns, by kind and start. The work is in proportion to the text."""
    found = [(0, a, b) for a, b in _emails(text)]
    for m in _IP.finditer(text):
        if all(len(p) < 4 and int(p or 0) < 256 for p in (x.lstrip("0") for x in m[0].split("."))):
            found.append((1, m.start(), m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = _NO_DIGIT.sub("", m[0])
            if 16 <= len(digits) <= 19 and luhn(digits):
                found.append((2, m.start(), m.end()))
    for m in _PHONE.finditer(text):
        if 8 <= len(_NO_DIGIT.sub("", m[0])) <= 15:
            found.append((3, m.start(), m.end()))
    return found


# characters: 0 parts texts, then ASCII letters without case, all digits alike, each mark, white space, other letters and signs
def _classes() -> np.ndarray:
    table = np.full(0x180, 2, np.uint8)
    marks = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
    for c in range(0x80):
        s = chr(c)
        table[c] = 1 if s.isdigit() else 3 if s == "\n" else 4 if s.isspace() else 5 + ord(s.lower()) - 97 if s.isalpha() else 31 + marks.find(s) if s in marks else 63
    return table


_CLASS = _classes()
CLASSES, OTHER = 64, 2


def classes_of(text: str) -> np.ndarray:
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    return _CLASS[np.minimum(codes, len(_CLASS) - 1)]


# --- labelled spans ---------------------------------------------------------------------------------------------------------------


def _card(draw: random.Random, length: int) -> str:
    digits = [draw.choice("3456"), *(str(draw.randrange(10)) for _ in range(length - 2))]
    return next(n for n in ("".join([*digits, str(d)]) for d in range(10)) if luhn(n))


def written_span(draw: random.Random, kind: int, word) -> str:
    """One span of a kind in one of its usual or unusual forms; ``word`` gives words of the corpus."""
    n = lambda k: "".join(str(draw.randrange(10)) for _ in range(k))
    if kind == 0:
        top = draw.choice(["com", "org", "net", "de", "fr", "es", "edu", "co.uk", "info"])
        local = word() + draw.choice(["", "", f".{word()}", f".{n(2)}", f"_{word()}", n(2)])
        host = draw.choice(["example", "mail", word(), f"mail{n(1)}.example", f"{word()}-{word()}"])
        at, dot = draw.choice(["@"] * 6 + [" @ ", " at ", " (at) ", "(at)", " [at] ", "[at]", " AT ", "{at}", " <at> "]), "."
        if at != "@":
            dot = draw.choice([" . "] if at == " @ " else [" dot ", "."] if at in (" at ", " AT ") else [at.replace("at", "dot"), "."])
        return f"{local}{at}{host}.{top}".replace(".", dot)
    if kind == 1:
        parts = [str(draw.randrange(256)) for _ in range(4)]
        form = draw.randrange(10)
        if form < 6:
            return ".".join(parts)
        if form < 8:
            return draw.choice(["[.]", "(.)", "[dot]"]).join(parts) if form == 6 else ".".join(parts[:3]) + "[.]" + parts[3]
        groups = [f"{draw.randrange(65536):x}" for _ in range(draw.choice([8, 8, 4]))]
        return ":".join(groups) if len(groups) == 8 else "::".join([":".join(groups[:3]), groups[3]])
    if kind == 2:
        form = draw.randrange(10)
        if form < 6:
            c, part = _card(draw, 16), draw.choice(["", "", " ", "-"])
            return part.join(c[i : i + 4] for i in range(0, 16, 4))
        if form < 8:
            c, part = _card(draw, 15), draw.choice(["", " ", "-"])
            return part.join((c[:4], c[4:10], c[10:]))
        c, part = _card(draw, 16), draw.choice([".", "/", "  ", "_", " - "])
        return part.join(c[i : i + 4] for i in range(0, 16, 4))
    form = draw.randrange(10)
    area, a, b = n(3), n(3), n(4)
    if form < 4:
        return draw.choice([f"+1 ({area}) {a}-{b}", f"+{n(2)} {n(2)} {n(4)} {n(4)}", f"+1-{area}-{a}-{b}", f"+{n(2)} {n(3)} {n(6)}"])
    return draw.choice([f"({area}) {a}-{b}", f"({area}) {a}-{b}", f"{area}-{a}-{b}", f"{area}.{a}.{b}", f"1-{area}-{a}-{b}", f"00{n(2)} {n(2)} {n(4)} {n(4)}", f"(0{n(2)}) {n(4)}-{n(3)}"])


def written_other(draw: random.Random, word) -> str:
    """Something alike that is no personal data."""
    n = lambda k: "".join(str(draw.randrange(10)) for _ in range(k))
    return draw.choice([
        n(draw.randint(1, 9)), f"{n(4)}-{n(2)}-{n(2)}", f"{n(2)}.{n(2)}.{n(4)}", f"{n(2)}:{n(2)}:{n(2)}", f"v{n(1)}.{n(1)}.{n(2)}", f"{n(1)}.{n(2)}.{n(1)}",
        f"${n(1)},{n(3)}.{n(2)}", f"{n(3)},{n(3)},{n(3)}", f"{n(2)}.{n(1)}%", f"{n(2)}-{n(2)}", f"({n(2)})", f"({n(4)})", f"{n(3)}/{n(2)}", f"ISBN 978-{n(1)}-{n(2)}-{n(6)}-{n(1)}",
        f'token = "{draw.randrange(16**40):040x}"', f"{draw.randrange(16**32):032x}", f"No. {n(4)}-{n(2)}", f"{n(4)} {n(2)} {n(2)}", f"at {word()}", f"{word()} at {word()}",
        f"{word()} dot {word()}", f"@{word()}", f"{word()}@{word()}", f"[{word()}]", f"({word()})", f"{word()}.{word()}", f"www.{word()}.com", f"https://{word()}.org/{word()}/{n(4)}", f"{n(12)}", f"{n(20)}", "&&&", "***", "$$$",
    ])


def training_windows(texts: list[str], windows: int = TRAIN_WINDOWS, length: int = TRAIN_LENGTH, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """Classes and tags, (position, window): windows of the texts with the patterns' finds, and with spans and other things written in."""
    draw = random.Random(seed)
    words = [w for t in texts for w in re.findall(r"[A-Za-z]{2,12}", t)] or ["word", "name"]
    word = lambda: draw.choice(words).lower()
    classes = np.zeros((length, windows), np.uint8)
    tags = np.zeros((length, windows), np.int64)
    for k in range(windows):
        text = draw.choice(texts)
        start = draw.randrange(max(1, len(text) - length // 2))
        text = text[start : start + length]
        kind = -1
        if k % 4:
            kind = draw.randrange(4)
            made = written_span(draw, kind, word)
        else:
            made = written_other(draw, word)
        if k % 8:
            cut = draw.choice([m.start() for m in re.finditer(r"\s", text)] or [0])
            a, b = draw.choice([(" ", " "), (" ", " "), (" ", ", "), (" ", ". "), (" (", ") "), ("\n", "\n"), (": ", " "), (" ", "&&& "), (" ", "!! "), ('"', '" ')])
            room = max(0, length - len(made) - len(a) - len(b))
            cut = min(cut, room)
            text = text[:cut] + a + made + b + text[cut:]
            at = cut + len(a)
        else:
            at, kind = 0, -1
        spans = [] if kind < 0 else [(kind, at, at + len(made))]
        spans += [s for s in base_spans(text) if not any(s[1] < b and a < s[2] for _, a, b in spans)]
        text = text[:length]
        classes[: len(text), k] = classes_of(text)
        for kind, a, b in spans:
            if b <= length:
                tags[a, k], tags[a + 1 : b, k] = 2 * kind + 1, 2 * kind + 2
    tags[classes == 0] = 0
    return classes, tags


def train(docs: DataFrame, documents: int = SAMPLE_DOCUMENTS, windows: int = TRAIN_WINDOWS, rounds: int = TRAIN_ROUNDS) -> Tagger | None:
    """Fit a tagger on a bounded sample: ``documents`` stretches of SAMPLE_LENGTH characters, at a place in the text given by a hash."""
    text = F.col("text").cast("string")
    h = F.xxhash64(text, F.col("doc_id").cast("string"))
    at = F.expr(f"1 + cast(pmod(h, greatest(1, length(text) - {SAMPLE_LENGTH})) AS int)")
    rows = docs.where(text.rlike("[A-Za-z0-9]")).select(h.alias("h"), text.alias("text")).select("h", F.substring("text", at, F.lit(SAMPLE_LENGTH)).alias("piece"))
    texts = [r.piece for r in rows.orderBy("h", "piece").limit(documents).collect()]
    if not any(re.search("[A-Za-z0-9]", t) for t in texts):
        return None
    tagger = Tagger(CLASSES, len(KINDS), WIDTH, SEED)
    tagger.fit(*training_windows(texts, windows), rounds, TRAIN_BATCH, seed=SEED)
    return tagger


# --- tagging ----------------------------------------------------------------------------------------------------------------------


def windows_of(length: int, window: int = WINDOW, overlap: int = OVERLAP) -> list[tuple[int, int]]:
    """Where the windows of a text begin and end: each repeats ``overlap`` characters of the one before."""
    step = window - overlap
    return [(s, min(s + window, length)) for s in range(0, max(1, length - overlap), step)] if length else []


def placed(pieces: list[tuple[int, int, int]], window: int = WINDOW) -> tuple[list[tuple[int, int]], int]:
    """A row and column for each (text, start, end); short ones share a row, with a part of one position between them."""
    out, rows, free = [], 0, 0
    for _, a, b in pieces:
        n = b - a
        if n + 1 > free:
            rows, free = rows + 1, window + 1
        out.append((rows - 1, window + 1 - free))
        free -= n + 1
    return out, rows


def window_spans(tagger: Tagger, texts: list[str], window: int = WINDOW, overlap: int = OVERLAP, rows: int = ROWS):
    """(text, kind, start, end, nats) of the spans decoded in every window of every text."""
    pieces = [(i, a, b) for i, t in enumerate(texts) for a, b in windows_of(len(t), window, overlap)]
    pieces.sort(key=lambda p: p[1] - p[2])  # the longest first
    places, count = placed(pieces, window)
    codes = {}
    for first in range(0, count, rows):
        here = [k for k, (r, _) in enumerate(places) if first <= r < first + rows] if count > rows else range(len(pieces))
        classes = np.zeros((window, min(rows, count - first)), np.uint8)
        for k in here:
            i, a, b = pieces[k]
            if i not in codes:
                codes[i] = classes_of(texts[i])
            r, c = places[k]
            classes[c : c + b - a, r - first] = codes[i][a:b]
        e = tagger.emissions(classes)
        hot = tagger.may_hold_spans(e)
        yield from _decoded(tagger, e, hot, [(*pieces[k], places[k][0] - first, places[k][1]) for k in here])


def _decoded(tagger, e, hot, pieces):
    """Decode the windows that may hold a span; all others stay outside."""
    seen = np.concatenate([np.zeros((1, hot.shape[1]), np.int64), np.cumsum(hot, axis=0)])
    chosen = [p for p in pieces if seen[p[4] + p[2] - p[1], p[3]] > seen[p[4], p[3]]]
    steps = tagger.steps()
    for s in range(0, len(chosen), 256):
        part = chosen[s : s + 256]
        longest = max(b - a for _, a, b, _, _ in part)
        block = np.full((longest, len(part), e.shape[2]), -1e4, e.dtype)
        block[:, :, 0] = 0
        for j, (_, a, b, r, c) in enumerate(part):
            block[: b - a, j] = e[c : c + b - a, r]
        path = tagger.decode(block)
        for j, (i, a, b, _, _) in enumerate(part):
            tags = path[: b - a, j].tolist()
            t = 0
            while t < len(tags):
                if not tags[t] % 2:
                    t += 1
                    continue
                end = t + 1
                while end < len(tags) and tags[end] == tags[t] + 1:
                    end += 1
                run = [0, *tags[t:end], 0]
                gain = sum(float(block[t + x, j, y] - block[t + x, j, 0]) for x, y in enumerate(tags[t:end]))
                gain += sum(float(steps[x, y] - steps[0, 0]) for x, y in zip(run, run[1:]))
                yield i, tags[t] // 2, a + t, a + end, gain
                t = end


def best_set(spans: list[tuple[int, int, int, float]]) -> list[tuple[int, int, int, float]]:
    """Of (kind, start, end, nats), those that do not overlap and are worth most together; equal ones count once, with their best nats."""
    best: dict[tuple[int, int, int], float] = {}
    for kind, a, b, nats in spans:
        best[a, b, kind] = max(nats, best.get((a, b, kind), nats))
    order = sorted(best, key=lambda s: (s[1], s[0], s[2]))
    ends = [s[1] for s in order]
    worth, took = [0.0], []
    for n, s in enumerate(order):
        before = bisect_right(ends, s[0], 0, n)
        taken = worth[before] + best[s]
        took.append(before if taken > worth[n] else None)
        worth.append(max(taken, worth[n]))
    out, n = [], len(order)
    while n:
        if took[n - 1] is None:
            n -= 1
        else:
            a, b, kind = order[n - 1]
            out.append((kind, a, b, best[order[n - 1]]))
            n = took[n - 1]
    return out[::-1]


_AT, _DOT = (rf"(?:\s?[{m}]\s?|\s?[\[({{<]\s?{w}\s?[\])}}>]\s?|\s{w}\s)" for m, w in (("@", "at"), (".", "dot")))
_ADDRESS = re.compile(rf"(?i)[\w%+-]+(?:{_DOT}[\w%+-]+)*{_AT}[\w-]+(?:{_DOT}[\w-]+)+")
_GROUPS = re.compile(r"(?i)[0-9a-f]{0,4}(?::[0-9a-f]{0,4}){3,7}")
_NUMBERS = re.compile("[0-9]+")
_DATE = re.compile(r"(?<![0-9])(?:[0-9]{4}([-./])[0-9]{2}\1[0-9]{2}|[0-9]{2}([-./])[0-9]{2}\2[0-9]{4})(?![0-9])")
_PARTED = re.compile("[0-9](?:[ ./_-]{0,3}[0-9])+")
_DIALLED = re.compile("[+(0-9][0-9 ()./+-]*[0-9]")


def plausible(kind: int, span: str) -> bool:
    """Whether a tagged span has the parts that its kind needs; the patterns' own finds are not asked."""
    digits = _NO_DIGIT.sub("", span)
    if kind == 0:
        return len(span) <= OVERLAP and bool(_ADDRESS.fullmatch(span))
    if kind == 1:
        parts = _NUMBERS.findall(span)
        return bool(_GROUPS.fullmatch(span)) or len(parts) == 4 and all(len(x) < 4 and int(x) < 256 for x in parts)
    if kind == 2:
        return 13 <= len(digits) <= 19 and luhn(digits) and bool(_PARTED.fullmatch(span)) and not _DATE.search(span)
    return 9 <= len(digits) <= 15 and len(digits) < len(span) and bool(_DIALLED.fullmatch(span)) and not _DATE.search(span)


def added_spans(tagger: Tagger, texts: list[str], base: list[list[tuple[int, int, int]]], certain: float = CERTAIN, window: int = WINDOW, overlap: int = OVERLAP):
    """For each text, the tagger's spans that are certain, plausible for their kind, and apart from those of the patterns."""
    found: list[list] = [[] for _ in texts]
    for i, kind, a, b, nats in window_spans(tagger, texts, window, overlap):
        found[i].append((kind, a, b, nats))
    out = []
    for text, known, spans in zip(texts, base, found, strict=True):
        taken = sorted((a, b) for _, a, b in known)
        out.append([(k, a, b) for k, a, b, nats in best_set(spans) if nats >= certain and not _meets(taken, a, b) and plausible(k, text[a:b])] if spans else [])
    return out


def _meets(taken: list[tuple[int, int]], a: int, b: int) -> bool:
    return any(x < b and a < y for x, y in taken)


def _text(spans) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in sorted(spans))


def find(docs: DataFrame, tagger: Tagger | None) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans) of every row: counts and digest of the patterns' spans, and all spans."""
    shared = docs.sparkSession.sparkContext.broadcast(tagger)
    names = ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"]

    def run(batches):
        for batch in batches:
            at = 0
            for values in slices_of(batch.column(1)):
                texts = [t or "" for t in values]
                for x, y in slices(texts, 2_000_000):
                    part = texts[x:y]
                    base = [base_spans(t) for t in part]
                    more = added_spans(shared.value, part, base) if shared.value is not None else [[]] * len(part)
                    counts = np.array([[sum(s[0] == k for s in b) for k in range(4)] for b in base])
                    columns = [batch.column(0).slice(at + x, y - x), *(pa.array(counts[:, k], pa.int64()) for k in range(4))]
                    columns.append(pa.array([hashlib.sha256(_text(b).encode()).hexdigest() for b in base]))
                    columns.append(pa.array([_text(b + m) for b, m in zip(base, more, strict=True)], pa.string()))
                    yield pa.RecordBatch.from_arrays(columns, names)
                at += len(texts)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(tidy(run), "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")
