"""Personal data: exact patterns, and a character BiLSTM-CRF for what they miss.

The patterns give the base spans. A bidirectional LSTM over characters with
CRF transitions is trained, in numpy, from labelled spans: the base spans of a
bounded sample of documents, as they stand, and others of all four kinds in
their places, written the way people veil them. It reads overlapping windows around
all places where a span can be; the windows are decoded by Viterbi, each
character takes the tag of the window in which it lies deepest, and spans are
read from the tags of the whole text. A new span must overlap no base span and
pass its kind's check; of a number that fails it, the kind whose check it
passes counts.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.llm import text as tx

KINDS = ("email", "ip", "card", "phone")
#: The bound of the training sample: documents, bytes of one, and windows, which are drawn from all these documents alike.
SAMPLE, SAMPLE_BYTES, MOST_WINDOWS = 500, 1 << 15, 2800
WINDOW, STRIDE, MARGIN = 96, 48, 48
#: Texts with spans are rewritten so many times at most, until there are enough windows.
MOST_TURNS = 60
DIM, HIDDEN, EPOCHS, BATCH, RATE = 12, 24, 6, 48, 0.02

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# possessive and bounded on the left: the same leftmost matches in linear time
_IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
#: A written-out @ with what the check of an address asks for after it.
_AT = re.compile(r"[\[({ ]at[\])} ]\s?[\w-]+\s?(?:\.|[\[({]?dot[\])}]?)\s?[\w-]", re.IGNORECASE)
#: Where a span can be: every kind's check asks for one of these.
_PLACE = re.compile(r"[0-9@]+|" + _AT.pattern, re.IGNORECASE)
_DOT = r"\s?(\.|[\[({]?dot[\])}]?)\s?"
_VEILED_EMAIL = re.compile(rf"[\w%+-]+({_DOT}[\w%+-]+)*\s?(@|[\[({{ ]at[\])}} ])\s?[\w-]+({_DOT}[\w-]+)+", re.IGNORECASE)


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = int(d) * (1 + k % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches; the local part runs left from each @ to the match before."""
    out, low, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > low and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            out.append((start, found.end()))
            low = found.end()
        else:
            low = at + 1
        at = text.find("@", low)
    return out


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of all pattern matches that pass, by start, then kind."""
    found = [(a, b, 0) for a, b in emails(text)]
    found += [(m.start(), m.end(), 1) for m in _IP.finditer(text) if all(int(x[-4:]) <= 255 and len(x.lstrip("0")) <= 3 for x in m.group().split("."))]
    found += [(m.start(), m.end(), 2) for m in _CARD.finditer(text) if 14 <= len(d := _digits(m.group())) <= 19 and luhn(d)]
    found += [(m.start(), m.end(), 3) for m in _PHONE.finditer(text) if 10 <= len(_digits(m.group())) <= 15]
    return [(a, b, KINDS[k]) for a, b, k in sorted(found, key=lambda x: (x[0], x[2], x[1]))]


def plausible(text: str, start: int, end: int, kind: str) -> bool:
    """The check of a span that only the model found."""
    span, digits = text[start:end], _digits(text[start:end])
    if end - start > WINDOW or (start and text[start - 1].isalnum()) or (end < len(text) and text[end].isalnum()):
        return False
    if kind == "email":
        return bool(_VEILED_EMAIL.fullmatch(span))
    if kind == "ip":
        parts = re.findall(r"[0-9]+", span)
        return len(parts) == 4 and all(len(x) <= 3 and int(x) <= 255 for x in parts) and bool(re.fullmatch(r"[0-9]+(\s?[\[(]?(\.|dot)[\])]?\s?[0-9]+){3}", span))
    if kind == "card":
        return 14 <= len(digits) <= 19 and luhn(digits) and bool(re.fullmatch(r"[0-9][0-9 ._/-]+[0-9]", span))
    return 10 <= len(digits) <= 15 and bool(re.fullmatch(r"\(?(00)?[0-9(][0-9 ().-]+[0-9]", span)) and len(re.findall(r"[ ().-]+", span)) >= 2


# --- the model ---

_OWN = "atdo@.+-_%()[]:/,'\" \n"
_CLASSES = len(_OWN) + 5
_TABLE = np.full(1 << 16, len(_OWN), np.int64)
_TABLE[[ord(c) for c in "0123456789"]] = len(_OWN) + 1
_TABLE[[ord(c) for c in "abcdefghijklmnopqrstuvwxyz"]] = len(_OWN) + 2
_TABLE[[ord(c) for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"]] = len(_OWN) + 3
_TABLE[[ord(c) for c in _OWN]] = np.arange(len(_OWN))
# "AT" and "DOT" are read as "at" and "dot"
_TABLE[[ord(c) for c in "ATDO"]] = _TABLE[[ord(c) for c in "atdo"]]
_PAD = len(_OWN) + 4
_TAGS = 1 + 2 * len(KINDS)


def encoded(text: str) -> np.ndarray:
    """The class of each character."""
    return _TABLE[np.minimum(np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32), 0xFFFF)]


def tags_of(length: int, spans: list[tuple[int, int, str]]) -> np.ndarray:
    """0 outside; 2k + 1 where a span of kind k begins, 2k + 2 within it. The first of overlapping spans stays."""
    tags = np.zeros(length, np.int64)
    for a, b, kind in spans:
        if not tags[a:b].any():
            k = KINDS.index(kind)
            tags[a], tags[a + 1 : b] = 2 * k + 1, 2 * k + 2
    return tags


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


class Tagger:
    """BiLSTM-CRF; parameters by name."""

    def __init__(self, seed: int = 5):
        rng = np.random.default_rng(seed)
        g = lambda *s: rng.normal(0, 1 / np.sqrt(s[0]), s).astype(np.float32)
        self.p = {"embed": g(_CLASSES, DIM)}
        for d in "fb":
            self.p |= {f"in_{d}": g(DIM, 4 * HIDDEN), f"rec_{d}": g(HIDDEN, 4 * HIDDEN), f"bias_{d}": np.zeros(4 * HIDDEN, np.float32)}
            self.p[f"bias_{d}"][HIDDEN : 2 * HIDDEN] = 1
        self.p |= {"out": g(2 * HIDDEN, _TAGS), "out_bias": np.zeros(_TAGS, np.float32), "move": np.zeros((_TAGS, _TAGS), np.float32)}
        # within a span of a kind only after its begin or itself
        self.legal = np.zeros((_TAGS, _TAGS), np.float32)
        for k in range(len(KINDS)):
            self.legal[:, 2 * k + 2] = -1e4
            self.legal[[2 * k + 1, 2 * k + 2], 2 * k + 2] = 0
        self.first = np.where(np.arange(_TAGS) % 2 == 0, -1e4, 0).astype(np.float32)
        self.first[0] = 0

    def _lstm(self, x: np.ndarray, d: str) -> tuple[np.ndarray, list]:
        if d == "b":
            x = x[:, ::-1]
        n, t, _ = x.shape
        into = x @ self.p[f"in_{d}"] + self.p[f"bias_{d}"]
        h = c = np.zeros((n, HIDDEN), np.float32)
        out, kept = np.empty((n, t, HIDDEN), np.float32), []
        for k in range(t):
            z = into[:, k] + h @ self.p[f"rec_{d}"]
            s = _sigmoid(z[:, : 3 * HIDDEN])
            i, f, o = s[:, :HIDDEN], s[:, HIDDEN : 2 * HIDDEN], s[:, 2 * HIDDEN :]
            g = np.tanh(z[:, 3 * HIDDEN :])
            before, prior = c, h
            c = f * before + i * g
            top = np.tanh(c)
            h = o * top
            out[:, k] = h
            kept.append((i, f, o, g, before, prior, top))
        return out[:, ::-1] if d == "b" else out, kept

    def _lstm_back(self, x: np.ndarray, d: str, kept: list, dout: np.ndarray, grads: dict) -> np.ndarray:
        if d == "b":
            x, dout = x[:, ::-1], dout[:, ::-1]
        dz = np.empty((*x.shape[:2], 4 * HIDDEN), np.float32)
        dh = dc = np.zeros((len(x), HIDDEN), np.float32)
        for k in range(x.shape[1] - 1, -1, -1):
            i, f, o, g, before, prior, top = kept[k]
            dh = dh + dout[:, k]
            dc = dc + dh * o * (1 - top * top)
            dz[:, k] = np.concatenate([dc * g * i * (1 - i), dc * before * f * (1 - f), dh * top * o * (1 - o), dc * i * (1 - g * g)], 1)
            grads[f"rec_{d}"] += prior.T @ dz[:, k]
            dh, dc = dz[:, k] @ self.p[f"rec_{d}"].T, dc * f
        grads[f"in_{d}"] += np.einsum("ntd,ntk->dk", x, dz)
        grads[f"bias_{d}"] += dz.sum((0, 1))
        dx = dz @ self.p[f"in_{d}"].T
        return dx[:, ::-1] if d == "b" else dx

    def scores(self, chars: np.ndarray) -> tuple[np.ndarray, tuple]:
        x = self.p["embed"][chars]
        (f, kf), (b, kb) = self._lstm(x, "f"), self._lstm(x, "b")
        both = np.concatenate([f, b], 2)
        return both @ self.p["out"] + self.p["out_bias"], (x, both, kf, kb)

    def step(self, chars: np.ndarray, tags: np.ndarray) -> dict:
        """Gradients of the mean negative log likelihood of the tag paths."""
        z, (x, both, kf, kb) = self.scores(chars)
        n, t, _ = z.shape
        move = self.p["move"] + self.legal
        alpha, beta = np.empty_like(z), np.zeros_like(z)
        alpha[:, 0] = z[:, 0] + self.first
        lse = lambda a: (m := a.max(1, keepdims=True))[:, 0] + np.log(np.exp(a - m).sum(1))
        for k in range(1, t):
            alpha[:, k] = z[:, k] + lse(alpha[:, k - 1, :, None] + move)
        for k in range(t - 2, -1, -1):
            beta[:, k] = lse((beta[:, k + 1] + z[:, k + 1])[:, :, None] + move.T)
        total = lse(alpha[:, -1])
        dz = np.exp(alpha + beta - total[:, None, None])
        dmove = np.zeros_like(move)
        for k in range(1, t):
            dmove += np.exp(alpha[:, k - 1, :, None] + move + (z[:, k] + beta[:, k])[:, None, :] - total[:, None, None]).sum(0)
        rows = np.arange(n)[:, None]
        dz[rows, np.arange(t), tags] -= 1
        np.add.at(dmove, (tags[:, :-1].ravel(), tags[:, 1:].ravel()), -1)
        dz, dmove = (dz / n).astype(np.float32), (dmove / n).astype(np.float32)
        grads = {name: np.zeros_like(v) for name, v in self.p.items()}
        grads["move"], grads["out_bias"], grads["out"] = dmove, dz.sum((0, 1)), np.einsum("nth,ntk->hk", both, dz)
        dboth = dz @ self.p["out"].T
        dx = self._lstm_back(x, "f", kf, dboth[:, :, :HIDDEN], grads) + self._lstm_back(x, "b", kb, dboth[:, :, HIDDEN:], grads)
        np.add.at(grads["embed"], chars, dx)
        return grads

    def fit(self, chars: np.ndarray, tags: np.ndarray) -> Tagger:
        rng, k = np.random.default_rng(11), 0
        moments = {name: (np.zeros_like(v), np.zeros_like(v)) for name, v in self.p.items()}
        for _ in range(EPOCHS):
            order = rng.permutation(len(chars))
            for at in range(0, len(order), BATCH):
                k += 1
                grads = self.step(chars[order[at : at + BATCH]], tags[order[at : at + BATCH]])
                norm = np.sqrt(sum(float((g * g).sum()) for g in grads.values()))
                for name, g in grads.items():
                    g = g * min(1.0, 5.0 / max(norm, 1e-9))
                    m, v = moments[name]
                    m += 0.1 * (g - m)
                    v += 0.01 * (g * g - v)
                    self.p[name] -= RATE * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-8)
        return self

    def decode(self, chars: np.ndarray) -> np.ndarray:
        """The best tag path of each window."""
        z, _ = self.scores(chars)
        move = self.p["move"] + self.legal
        best, back = z[:, 0] + self.first, []
        for k in range(1, z.shape[1]):
            all_ = best[:, :, None] + move
            back.append(all_.argmax(1))
            best = all_.max(1) + z[:, k]
        path = [best.argmax(1)]
        for b in reversed(back):
            path.append(b[np.arange(len(b)), path[-1]])
        return np.stack(path[::-1], 1)


def places(text: str) -> list[tuple[int, int]]:
    """Stretches of text around everything that a span must contain."""
    out: list[tuple[int, int]] = []
    for m in _PLACE.finditer(text):
        a, b = max(0, m.start() - MARGIN), min(len(text), m.end() + MARGIN)
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], b)
        else:
            out.append((a, b))
    return out


def windows(text: str, chars: np.ndarray) -> tuple[list[np.ndarray], list[int]]:
    """Overlapping windows over the places, padded, and where each begins."""
    found, starts = [], []
    for a, b in places(text):
        for s in range(a, max(a + 1, b - STRIDE), STRIDE):
            row = np.full(WINDOW, _PAD, np.int64)
            part = chars[s : s + WINDOW]
            row[: len(part)] = part
            found.append(row)
            starts.append(s)
    return found, starts


def reconciled(length: int, starts: list[int], paths: np.ndarray) -> np.ndarray:
    """The tag of each character from the window in which it lies deepest, the earlier of equals."""
    tags, depth = np.zeros(length, np.int64), np.full(length, -1)
    deep = np.minimum(np.arange(WINDOW), np.arange(WINDOW)[::-1])
    for s, path in zip(starts, paths, strict=True):
        n = min(WINDOW, length - s)
        better = np.flatnonzero(deep[:n] > depth[s : s + n])
        tags[s + better], depth[s + better] = path[better], deep[better]
    return tags


def spans_of(tags: np.ndarray) -> list[tuple[int, int, str]]:
    out, k = [], 0
    inside = np.flatnonzero(tags).tolist()
    while k < len(inside):
        start = inside[k]
        kind = (tags[start] - 1) // 2
        end = start + 1
        while end < len(tags) and tags[end] == 2 * kind + 2:
            end += 1
        out.append((start, end, KINDS[kind]))
        while k < len(inside) and inside[k] < end:
            k += 1
    return out


def made_up(kind: str, words: list[str], rng: np.random.Generator) -> str:
    """Data of a kind in its plain form, from random digits and the words around."""
    pick = lambda x: x[rng.integers(len(x))]
    digits = lambda n: "".join(map(str, rng.integers(0, 10, n)))
    if kind == "email":
        word = lambda: pick(words)
        local = pick([word(), word(), word(), f"{word()}.{word()}", f"{word()}{digits(2)}", f"{word()}.{digits(2)}", f"{word()}_{word()}"])
        return f"{local}@{pick([word(), word(), word(), f'mail{digits(1)}.{word()}', f'{word()}-{word()}', f'mail{digits(1)}.example'])}.{pick(['com', 'org', 'net', 'de', 'fr', 'es', 'co.uk', 'io'])}"
    if kind == "ip":
        return ".".join(map(str, rng.integers(0, 256, 4)))
    if kind == "card":
        body = pick(["4", "5", "37", "60"]) + digits(14)
        body = body[: pick([14, 15, 15, 15])]
        return next(body + d for d in "0123456789" if luhn(body + d))
    return f"+{pick(['1', '44', '49', '33', '34'])} {pick([f'({digits(3)}) {digits(3)}-{digits(4)}', f'{digits(2)} {digits(4)} {digits(4)}', f'{digits(3)} {digits(3)} {digits(3)}', f'{digits(2)} {digits(3)} {digits(2)} {digits(2)}'])}"


#: How @ and . are written out; each pair is learnt from alike, one in three in capitals.
EMAIL_FORMS = ((" at ", " dot "), (" at ", " dot "), (" at ", "."), (" (at) ", " dot "), (" (at) ", " (dot) "), ("(at)", "(dot)"), ("(at)", "."), (" (at) ", "."), (" [at] ", " [dot] "), ("[at]", "[dot]"), (" [at] ", "."), (" @ ", "."), (" @ ", " dot "), ("{at}", "{dot}"), (" {at} ", "."))


def veiled(span: str, kind: str, rng: np.random.Generator) -> str:
    """A way in which people rewrite such data, which the patterns miss."""
    pick = lambda *x: x[rng.integers(len(x))]
    if kind == "email":
        at, dot = EMAIL_FORMS[rng.integers(len(EMAIL_FORMS))]
        text = span.replace(".", dot).replace("@", at)
        return text if rng.integers(3) else pick(text.upper(), span.replace(".", dot.upper()).replace("@", at.upper()))
    if kind == "ip":
        return span.replace(".", pick("[.]", " . ", " dot ", "(.)"))
    if kind == "card":
        d = _digits(span)
        return pick(".", "/", " - ", "_").join(d[k : k + 4] for k in range(0, len(d), 4))
    bare = span.lstrip("+").strip()
    # not all of these have so many digits as the check asks for
    return pick("00", "00 ", "", "(0)") + pick(bare, re.sub("[ ()-]+", pick(" ", ".", "-"), bare))


#: What is put in a span's place, each alike, whatever kind the span is of: e-mail addresses and phone numbers have the most forms.
DRAWN = ("email", "email", "email", "ip", "card", "phone", "phone", "phone")


def rewritten(text: str, spans: list[tuple[int, int, str]], rng: np.random.Generator) -> tuple[str, list[tuple[int, int, str]]]:
    """The text with other, veiled data in place of its spans, and where they are."""
    words = [w.lower() for w in re.findall(r"[A-Za-z]{3,9}", text[: 1 << 12])] or ["name"]
    out, moved, at, size = [], [], 0, 0
    for a, b, _ in spans:
        kind = DRAWN[rng.integers(len(DRAWN))]
        new = veiled(made_up(kind, words, rng), kind, rng)
        out += [text[at:a], new]
        size += a - at
        moved.append((size, size + len(new), kind))
        size += len(new)
        at = b
    return "".join([*out, text[at:]]), moved


#: What may be data that the patterns miss: numbers of so many digits in any grouping, and addresses but for those that a sentence's end makes.
_NUMBER = re.compile(r"[0-9](?:[0-9 ().\[\]/_-]|dot)*[0-9]")
_NO_SENTENCE = re.compile(r"@|[\[({]|\bdot\b|\w\.\w", re.IGNORECASE)


def unsure_spans(text: str) -> list[tuple[int, int]]:
    found = [m.span() for m in _NUMBER.finditer(text) if len(_digits(m.group())) >= 9 or re.fullmatch(r"[0-9]{1,3}(\D+[0-9]{1,3}){3}", m.group())]
    return found + [m.span() for m in _VEILED_EMAIL.finditer(text) if _NO_SENTENCE.search(m.group())]


def _add_windows(found: list[list], text: str, spans: list[tuple[int, int, str]]) -> None:
    """Windows and their tags, to the list of those without or with a span; those with what is unsure are left out."""
    own, c = tags_of(len(text), spans), encoded(text)
    unsure = np.zeros(len(text) + 1, np.int64)
    for a, b in unsure_spans(text):
        if not own[a:b].any():
            unsure[a] += 1
            unsure[b] -= 1
    unsure = np.cumsum(unsure) > 0
    for row, start in zip(*windows(text, c), strict=True):
        y = own[start : start + WINDOW]
        if not (unsure[start : start + WINDOW].any() or (len(y) and y[0] and y[0] % 2 == 0)):
            found[bool(y.any())].append((row, np.pad(y, (0, WINDOW - len(y)))))


def training_windows(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Windows and tags from labelled texts as they are and rewritten."""
    rng = np.random.default_rng(3)
    found: list[list] = [[], []]
    labelled = []
    for text in texts:
        spans, at = [], 0
        for a, b, kind in base_spans(text):
            if a >= at:
                spans.append((a, b, kind))
                at = b
        labelled.append((text, spans))
    for turn in range(MOST_TURNS):
        if turn > 3 and len(found[1]) >= MOST_WINDOWS:
            break
        for text, spans in labelled:
            if not turn:
                _add_windows(found, text, spans)
            elif spans:
                t, moved = rewritten(text, spans, rng)
                _add_windows(found, t, [s for s in moved if plausible(t, *s)])
    # three of four have a span, as far as there are so many
    with_span = [found[1][k] for k in rng.permutation(len(found[1]))[: MOST_WINDOWS * 3 // 4]]
    without = [found[0][k] for k in rng.permutation(len(found[0]))[: MOST_WINDOWS - len(with_span)]]
    chars, tags = ([x[k] for x in with_span + without] for k in (0, 1))
    return np.array(chars).reshape(-1, WINDOW), np.array(tags).reshape(-1, WINDOW)


def trained(docs: DataFrame) -> Tagger | None:
    """From the base spans of the sample: documents that look like having some, whose texts hash lowest. None if it has no spans."""
    looks = r"@|[0-9][0-9 ().-]{7,}[0-9]"
    some = docs.filter((F.octet_length("text") <= SAMPLE_BYTES) & F.col("text").rlike(looks)).select("text", F.xxhash64("text").alias("hash"))
    # hashes first, so that texts of which there are many copies count once and no others are moved
    lowest = [r[0] for r in some.select("hash").distinct().orderBy("hash").limit(SAMPLE).collect()]
    rows = some.filter(F.col("hash").isin(lowest)).groupBy("hash").agg(F.min("text").alias("text")).orderBy("hash").collect() if lowest else []
    chars, tags = training_windows([r["text"] for r in rows])
    return Tagger().fit(chars, tags) if tags.any() else None


SCHEMA = pa.schema([("doc_id", pa.int64()), *[(f"n_{k}", pa.int64()) for k in KINDS], ("base_sha256", pa.string()), ("spans", pa.string()), ("n_spans", pa.int64())])
_MARK = np.zeros(256, bool)
_MARK[list(b"0123456789@")] = True
_BEFORE_AT, _AFTER_AT = np.zeros((2, 256), bool)
_BEFORE_AT[list(b"[({ ")] = _AFTER_AT[list(b"])} ")] = True
DECODED = 512


def _found(chunk: tx.Chunk, model: Tagger | None) -> dict:
    base: list[list] = [[] for _ in range(len(chunk))]
    more: list[list] = [[] for _ in range(len(chunk))]
    raw = chunk.buf.tobytes()
    # a place needs a digit, an @ or an "at"
    low = tx.LOWER[chunk.buf]
    at_word = np.zeros(len(low), bool)
    at_word[1:-2] = (low[1:-2] == 97) & (low[2:-1] == 116) & _BEFORE_AT[low[:-3]] & _AFTER_AT[low[3:]]
    live = chunk.per_doc(_MARK[chunk.buf] | at_word) > 0
    rows, kept = [], []
    for d, (a, b) in enumerate(zip(chunk.offs[:-1].tolist(), chunk.offs[1:].tolist(), strict=True)):
        if not live[d]:
            continue
        text = raw[a:b].decode("utf-8", "replace")
        base[d] = base_spans(text)
        if model is not None:
            found, starts = windows(text, encoded(text))
            rows += found
            if starts:
                kept.append((d, text, starts))
    if rows:
        chars = np.array(rows)
        paths = np.concatenate([model.decode(chars[k : k + DECODED]) for k in range(0, len(chars), DECODED)])
        at = 0
        for d, text, starts in kept:
            tags = reconciled(len(text), starts, paths[at : at + len(starts)])
            at += len(starts)
            for a, b, kind in spans_of(tags):
                while b > a and text[b - 1] in " \n.,":
                    b -= 1
                while a < b and text[a] in " \n":
                    a += 1
                kind = next((k for k in (kind, *KINDS) if plausible(text, a, b, k)), None)
                if kind and all(b <= x or a >= y for x, y, _ in base[d]):
                    more[d].append((a, b, kind))
    joined = lambda spans: ",".join(f"{k}:{a}:{b}" for a, b, k in sorted(spans, key=lambda s: (s[0], KINDS.index(s[2]), s[1])))
    return (
        {"doc_id": chunk.batch.column(0)}
        | {f"n_{k}": np.array([sum(s[2] == k for s in spans) for spans in base], np.int64) for k in KINDS}
        | {"base_sha256": [hashlib.sha256(joined(s).encode()).hexdigest() for s in base], "spans": [joined(s + m) for s, m in zip(base, more, strict=True)], "n_spans": [len(s + m) for s, m in zip(base, more, strict=True)]}
    )


def personal_data(docs: DataFrame) -> DataFrame:
    """Spans of personal data in each whole text.

    One row for each row: doc_id, n_email, n_ip, n_card and n_phone (base
    spans), base_sha256 (of these, as kind:start:end joined by commas), spans
    (base and model) and their number n_spans. Offsets are code points, the end is exclusive. A
    null or empty text has none. Null and repeated doc_ids pass through.
    Without base spans in the sample there is no model, and base spans are
    all. Spans of the model have at most WINDOW characters, as its windows do;
    base spans have no bound. Columns other than doc_id and text are ignored; an
    empty table gives no rows.
    """
    docs = tx.documents_of(docs)
    shared = docs.sparkSession.sparkContext.broadcast(trained(docs))
    return tx.map_chunks(docs, lambda chunk: _found(chunk, shared.value), SCHEMA)
