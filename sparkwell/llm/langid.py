"""Languages of documents, chunks and their single-language stretches.

A bidirectional gated recurrent network reads the bytes of a line or sentence and
gives every position a probability for each language. It is trained here, in numpy,
by backpropagation through time, on lines of documents that have a usable language
label: a sample of at most `train_docs` documents (the least hashes of the id), as
labels are many and noisy. After a first round, lines that the network is sure
belong to another language than their label are left out of the second.

Codes, figures, addresses and capitalised names have no language and are taken out
first; in a line with words of another script, so are Latin letters. The network
reads what is left of every line, and the line's probabilities are pooled over all
its positions. A line of six words or more of which training has seen hardly any is in another
language than the five, and counts as without one. Stretches go by the positions themselves where a line may be mixed:
words take the mean of their positions, and a change of language has to gain more than it costs. A
unit's languages are those of its whole sentences, headings and lines; the confidence
is the share of probability that the network gives to the language there. Neighbouring
lines of one language form a stretch.

Defined results: null and empty texts, and texts of names, codes and figures only,
have no language. A cut sentence at either end of a chunk counts only where nothing
else tells the chunk's language. Lines without a language go with the stretch before
them, or the first one after. Repeated rows give repeated results.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.lang import STOPWORDS
from .sentences import sentence_ends

LANGUAGES = ("en", "de", "zh", "ar", "ur")
SCRIPTS = ([0, 1], [2], [3, 4])
HIDDEN = 8
#: Lines whose results a task keeps at a time.
KNOWN = 100_000

# Other notations of the five languages, after case and region are taken off.
NOTATIONS = {
    "en": "en", "eng": "en", "english": "en", "englisch": "en", "de": "de", "deu": "de", "ger": "de", "german": "de", "deutsch": "de",
    "zh": "zh", "zho": "zh", "chi": "zh", "cmn": "zh", "chinese": "zh", "mandarin": "zh", "中文": "zh", "ar": "ar", "ara": "ar", "arabic": "ar", "العربية": "ar",
    "ur": "ur", "urd": "ur", "urdu": "ur", "اردو": "ur",
}


def language_label(c: Column) -> Column:
    """One of the five codes, or null."""
    base = F.regexp_extract(F.lower(F.trim(c)), r"^([^\-_ (]+)", 1)
    known = F.create_map(*[F.lit(x) for kv in NOTATIONS.items() for x in kv])
    return F.element_at(known, base)


# ---- the network


class ByteGRU:
    """Two gated recurrent layers over bytes, one in each direction, and a softmax at every position."""

    NAMES = ("Ef", "Uf", "bf", "Eb", "Ub", "bb", "W", "c")

    def __init__(self, hidden: int = HIDDEN, seed: int = 7):
        r = np.random.default_rng(seed)
        h = hidden
        self.h = h
        for d in "fb":
            setattr(self, "E" + d, (r.standard_normal((256, 3 * h)) * 0.3).astype(np.float32))
            setattr(self, "U" + d, (r.standard_normal((h, 3 * h)) / np.sqrt(h)).astype(np.float32))
            setattr(self, "b" + d, np.zeros(3 * h, np.float32))
        self.W = (r.standard_normal((2 * h, len(LANGUAGES))) / np.sqrt(2 * h)).astype(np.float32)
        self.c = np.zeros(len(LANGUAGES), np.float32)

    def weights(self) -> list[np.ndarray]:
        return [getattr(self, n) for n in self.NAMES]

    def _states(self, x: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Hidden states (time, batch, 2h) of both directions side by side, without what training keeps.

        x (time, batch, 2): bytes from the start of a line, and from its end. The lines are in order
        of length: at time t those from first[t] on go on.
        """
        h = self.h
        cut = lambda n, d, k: getattr(self, n + d)[..., k * h : (k + 1) * h]

        def both(k: int) -> tuple[np.ndarray, np.ndarray]:
            """Weights of one gate: a row for each byte and direction, and a matrix of two blocks."""
            u = np.zeros((2 * h, 2 * h), np.float32)
            u[:h, :h], u[h:, h:] = cut("U", "f", k), cut("U", "b", k)
            return np.stack([cut("E", d, k) + cut("b", d, k) for d in "fb"], 1).reshape(-1, h), u

        (ez, uz), (er, ur), (ec, uc) = both(0), both(1), both(2)
        ez, er, uz, ur = 0.25 * ez + np.float32(0.5), 0.25 * er + np.float32(0.5), 0.25 * uz, 0.25 * ur
        lines = x.shape[1]
        out = np.zeros((len(x), lines, 2 * h), np.float32)
        state, a, b, c = (np.zeros((lines, 2 * h), np.float32) for _ in range(4))
        zero, one = np.float32(0), np.float32(1)
        for t in range(len(x)):
            j = first[t]
            s, at, r, new, more = state[j:], x[t, j:], a[j:], b[j:], c[j:]
            rows = more.reshape(len(at), 2, h)
            np.matmul(s, ur, out=r)
            er.take(at, axis=0, out=rows, mode="clip")
            r += more
            r.clip(zero, one, out=r)
            r *= s
            np.matmul(r, uc, out=new)
            ec.take(at, axis=0, out=rows, mode="clip")
            new += more
            np.abs(new, out=r)
            r += one
            new /= r
            new -= s
            np.matmul(s, uz, out=r)
            ez.take(at, axis=0, out=rows, mode="clip")
            r += more
            r.clip(zero, one, out=r)
            new *= r
            s += new
            out[t, j:] = s
        return out

    def _by_language(self, x: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Probabilities (languages, time, batch) at every position of lines (time, batch), in order of their sizes."""
        time, lines = x.shape
        first = np.searchsorted(sizes, np.arange(time), side="right")
        # the place of the byte that is as far from the end of its line as (t, line) is from the start
        back = np.maximum(sizes - 1 - np.arange(time)[:, None], 0) * lines + np.arange(lines)
        both = np.empty((time, lines, 2), np.intp)
        np.multiply(x, 2, out=both[..., 0], dtype=np.intp)
        np.add(2 * x.take(back).astype(np.intp), 1, out=both[..., 1])
        states = self._states(both, first).reshape(-1, 2 * self.h).T
        p = (self.W[self.h :].T @ states[self.h :]).take(back.ravel(), axis=1)
        p += self.W[: self.h].T @ states[: self.h]
        p += self.c[:, None]
        np.exp(p, out=p)
        p /= p.sum(0)
        return p.reshape(-1, time, lines)

    def positions(self, x: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Probabilities (time, batch, languages) at every position of lines (time, batch), in order of their sizes."""
        return np.moveaxis(self._by_language(x, sizes), 0, -1)

    def pooled(self, x: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Probabilities of lines, pooled over their positions."""
        p = self._by_language(x, sizes)
        p *= np.arange(len(x))[:, None] < sizes
        return p.sum(1).T / np.maximum(sizes, 1)[:, None]

    def _layer(self, x: np.ndarray, mask: np.ndarray, d: str, keep: bool) -> tuple:
        """x, mask: (time, batch). Hidden states (time, batch, h) and what backpropagation needs."""
        e, u, b = getattr(self, "E" + d) + getattr(self, "b" + d), getattr(self, "U" + d), None
        h, n = self.h, x.shape[1]
        uz, uc = np.ascontiguousarray(u[:, : 2 * h]), np.ascontiguousarray(u[:, 2 * h :])
        state = np.zeros((n, h), np.float32)
        out = np.empty((len(x), n, h), np.float32)
        kept = []
        for t in range(len(x)) if d == "f" else range(len(x) - 1, -1, -1):
            ex = e[x[t]]
            g = state @ uz
            g += ex[:, : 2 * h]
            g *= 0.25
            g += 0.5
            np.minimum(np.maximum(g, 0.0, out=g), 1.0, out=g)
            z, r = g[:, :h], g[:, h:]
            cand = (r * state) @ uc
            cand += ex[:, 2 * h :]
            cand /= 1.0 + np.abs(cand)
            new = cand - state
            new *= z
            if mask is not None:
                new *= mask[t][:, None]
            if keep:
                kept.append((t, state, g, cand))
            state = state + new
            out[t] = state
        return out, kept

    def forward(self, x: np.ndarray, mask: np.ndarray | None, keep: bool = False) -> tuple:
        """Probabilities (time, batch, languages)."""
        hf, kf = self._layer(x, mask, "f", keep)
        hb, kb = self._layer(x, mask, "b", keep)
        h = self.h
        logits = (hf.reshape(-1, h) @ self.W[:h] + hb.reshape(-1, h) @ self.W[h:] + self.c).reshape(*x.shape, -1)
        logits -= logits.max(-1, keepdims=True)
        np.exp(logits, out=logits)
        logits /= logits.sum(-1, keepdims=True)
        return logits, hf, hb, kf, kb

    def _back_layer(self, x: np.ndarray, mask: np.ndarray, grad: np.ndarray, kept: list, d: str) -> tuple:
        u, h = getattr(self, "U" + d), self.h
        ge, gu, gb = np.zeros((256, 3 * h), np.float32), np.zeros_like(u), np.zeros(3 * h, np.float32)
        carry = np.zeros_like(grad[0])
        for t, before, g, cand in reversed(kept):
            z, r = g[:, :h], g[:, h:]
            dh = (grad[t] + carry) * 1.0
            m = mask[t][:, None]
            dnew = dh * m
            dz = dnew * (cand - before)
            dcand = dnew * z * (1 - np.abs(cand)) ** 2
            dstate = dh - dnew * z
            rs = r * before
            drs = dcand @ u[:, 2 * h :].T
            dr = drs * before
            dstate += drs * r
            dg = np.concatenate([dz, dr], 1) * 0.25 * ((g > 0) & (g < 1))
            dstate += dg @ u[:, : 2 * h].T
            gu[:, : 2 * h] += before.T @ dg
            gu[:, 2 * h :] += rs.T @ dcand
            full = np.concatenate([dg, dcand], 1)
            np.add.at(ge, x[t], full)
            gb += full.sum(0)
            carry = dstate
        return ge, gu, gb

    def loss_gradients(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> tuple[float, list[np.ndarray]]:
        """Mean cross entropy over the positions of the lines, and its gradients; y: a label for each line, or for each position."""
        p, hf, hb, kf, kb = self.forward(x, mask, keep=True)
        total, h = mask.sum(), self.h
        labels = np.broadcast_to(y, x.shape)[..., None]
        at = np.take_along_axis(p, labels, -1)[..., 0]
        loss = float(-(np.log(np.maximum(at, 1e-9)) * mask).sum() / total)
        dl = p.copy()
        np.put_along_axis(dl, labels, np.take_along_axis(dl, labels, -1) - 1, -1)
        dl *= (mask / total)[..., None]
        flat = dl.reshape(-1, dl.shape[-1])
        gw = np.concatenate([hf.reshape(-1, h).T @ flat, hb.reshape(-1, h).T @ flat])
        gf = self._back_layer(x, mask, (dl @ self.W[:h].T).astype(np.float32), kf, "f")
        gb = self._back_layer(x, mask, (dl @ self.W[h:].T).astype(np.float32), kb, "b")
        return loss, [gf[0], gf[1], gf[2], gb[0], gb[1], gb[2], gw, flat.sum(0)]


def train(lines: list[tuple[bytes, int]], steps: int = 160, batch: int = 120, width: int = 56, seed: int = 7, model: ByteGRU | None = None, rate: float = 0.02, mixed: float = 0.0) -> ByteGRU:
    """Adam over random windows of the lines, as many of each language; a share `mixed` of them goes on in another one."""
    r = np.random.default_rng(seed)
    model = model or ByteGRU()
    by = [[b for b, y in lines if y == k and len(b) >= 4] for k in range(len(LANGUAGES))]
    present = [k for k in range(len(LANGUAGES)) if by[k]]
    if not present:
        return model
    ws = model.weights()
    m, v = [np.zeros_like(w) for w in ws], [np.zeros_like(w) for w in ws]
    for step in range(1, steps + 1):
        x, mask, y = np.zeros((width, batch), np.uint8), np.zeros((width, batch), np.float32), np.zeros((width, batch), np.int64)
        for j in range(batch):
            k = present[j % len(present)]
            line = by[k][int(r.integers(len(by[k])))]
            a = int(r.integers(max(1, len(line) - width + 1)))
            part = np.frombuffer(line[a : a + width], np.uint8)
            x[: len(part), j], mask[: len(part), j], y[:, j] = part, 1, k
            if mixed and r.random() < mixed:
                other = present[int(r.integers(len(present)))]
                second = by[other][int(r.integers(len(by[other])))]
                # both start with whole words
                cut = line[a : a + width].rfind(b" ", 0, int(r.integers(width // 3, width))) + 1
                more = np.frombuffer(second[: width - cut], np.uint8)
                x[cut : cut + len(more), j], mask[: cut + len(more), j], y[cut:, j] = more, 1, other
                x[cut + len(more) :, j], mask[cut + len(more) :, j] = 0, 0
        _, grads = model.loss_gradients(x, mask, y)
        norm = np.sqrt(sum(float((g * g).sum()) for g in grads))
        for w, g, mm, vv in zip(ws, grads, m, v):
            g = g * min(1.0, 1.0 / max(norm, 1e-9))
            mm += 0.1 * (g - mm)
            vv += 0.01 * (g * g - vv)
            w -= rate * (1 - step / (steps + 1)) ** 0.5 * (mm / (1 - 0.9**step)) / (np.sqrt(vv / (1 - 0.99**step)) + 1e-8)
    return model


# ---- lines

_FOREIGN = re.compile(r"[^\W\d_A-Za-zÀ-ɏ]+")
_LETTERS = re.compile(r"[^\W\d_]+")
_STOP = re.compile(r"[.!?。！？؟۔…][\"”»’‘“)）\]*_]*$")
_CODE = re.compile(r"[0-9@]|://")


def prepared(line: str) -> tuple[str, int]:
    """The words of the line that have a language, in lower case, and what they prove (0: nothing, 1: little, 2: enough)."""
    if not line.isascii():
        # Latin letters in a line of another script are names and codes
        words = _FOREIGN.findall(line)
        if words:
            enough = len(words) >= 2 or len(words[0]) >= 3 and "㐀" <= words[0][0] <= "鿿"
            return " ".join(words), 2 if enough else 1
    tokens = line.split()
    coded = _CODE.search if _CODE.search(line) else None
    words = [t for t in tokens if t[0].islower() and (coded is None or t.isalpha() or not coded(t))]
    if len(words) >= 2:
        return " ".join(words), 2
    if coded:
        tokens = [t for t in tokens if not coded(t)]
    words = _LETTERS.findall(" ".join(tokens))
    caps = sum(w.isupper() and len(w) > 1 for w in words)
    return " ".join(words).lower(), 2 if caps >= 5 and caps * 2 > len(words) else 1 if words else 0


def _batches(lines: list[bytes], block: int = 1 << 19) -> Iterator[tuple[list[int], np.ndarray, np.ndarray]]:
    """Numbers, bytes (time, line) and sizes of lines of like length."""
    order = sorted(range(len(lines)), key=lambda k: len(lines[k]))
    first = 0
    while first < len(order):
        last, shortest = first + 1, len(lines[order[first]])
        while last < len(order) and len(lines[order[last]]) * (last + 1 - first) <= block and len(lines[order[last]]) <= 1.25 * shortest + 8:
            last += 1
        part = order[first:last]
        width = max(1, len(lines[part[-1]]))
        sizes = np.array([len(lines[k]) for k in part])
        x = np.frombuffer(b"".join(lines[k].ljust(width, b" ") for k in part), np.uint8).reshape(len(part), width).T
        yield part, np.ascontiguousarray(x), sizes
        first = last


def line_probabilities(model: ByteGRU, lines: list[bytes]) -> np.ndarray:
    """Probabilities of each line, pooled over its positions."""
    out = np.zeros((len(lines), len(LANGUAGES)))
    for part, x, sizes in _batches(lines):
        out[part] = model.pooled(x, sizes)
    return out


class Detector:
    """The trained network, and the words that it was trained on: lines of hardly any known word are in another language."""

    def __init__(self, model: ByteGRU, vocabulary: set[str]):
        self.model, self.vocabulary = model, vocabulary

    def knows(self, words: str, least: float = 0.15, enough: int = 6) -> bool:
        units = words.split()
        if units and max(units) >= "぀":
            units = [c for w in units for c in (w if "぀" <= w[0] <= "鿿" else (w,))]
        return len(units) < enough or sum(map(self.vocabulary.__contains__, units)) >= least * len(units)


_UNIT = re.compile(r"[぀-鿿]|[^\W\d_぀-鿿]+")
#: What a change of language within a line has to gain, in the logarithm of probability.
SWITCH = 12.0


def may_be_mixed(line: str, p: np.ndarray | None) -> bool:
    """Whether a line is worth a look at every position: whole words of two scripts, or an unsure network."""
    latin = sum(len(w) > 1 and w.isascii() and w.islower() for w in line.split())
    other = len("".join(_FOREIGN.findall(line))) if not line.isascii() else 0
    return latin >= 2 and other >= 4 or p is not None and float(p.max()) < 0.9 and len(line.split()) >= 6


def line_parts(detector: Detector, lines: list[str]) -> list[list[tuple[int, int, float]]]:
    """For each line its parts of one language: (end, language, confidence), from the labels of all positions.

    Words take the mean of their positions; the parts are the likeliest ones if each change costs SWITCH.
    """
    spans = [[m.span() for m in _UNIT.finditer(line) if not (m.group()[0].isupper() and m.start())] for line in lines]
    coded = [[line[a:b].lower().encode("utf-8", "replace") for a, b in own] for line, own in zip(lines, spans)]
    out: list[list[tuple[int, int, float]]] = [[] for _ in lines]
    for part, x, sizes in _batches([b" ".join(c) for c in coded]):
        every = np.log(np.maximum(detector.model.positions(x, sizes), 1e-6))
        for column, k in enumerate(part):
            own, at = spans[k], 0
            if not own:
                continue
            score = np.zeros((len(own), len(LANGUAGES)))
            for w, code in enumerate(coded[k]):
                score[w] = every[at : at + len(code), column].mean(0) * (2 if len(code) > 3 else 1)
                at += len(code) + 1
            best, back = score[0].copy(), np.zeros(score.shape, np.int64)
            for w in range(1, len(own)):
                jump = int(best.argmax())
                stay = best >= best[jump] - SWITCH
                back[w] = np.where(stay, np.arange(len(LANGUAGES)), jump)
                best = np.where(stay, best, best[jump] - SWITCH) + score[w]
            path = [int(best.argmax())]
            for w in range(len(own) - 1, 0, -1):
                path.append(int(back[w][path[-1]]))
            path.reverse()
            first = 0
            for w in range(1, len(own) + 1):
                if w == len(own) or path[w] != path[first]:
                    sure = float(np.exp(score[first:w, path[first]] / np.array([2 if len(c) > 3 else 1 for c in coded[k][first:w]])).mean())
                    out[k].append((own[w][0] if w < len(own) else len(lines[k]), path[first], sure))
                    first = w
    return out


class Known:
    """The probabilities of lines that a task has read: rows of `p`, and whether the network knows their words."""

    def __init__(self) -> None:
        self.row: dict[str, int] = {}
        self.p = np.zeros((0, len(LANGUAGES)))
        self.sure = np.zeros(0, bool)

    def add(self, detector: Detector) -> None:
        """Read the lines that have a row but no probabilities yet."""
        new = list(self.row)[len(self.p) :]
        if new:
            self.p = np.concatenate([self.p, line_probabilities(detector.model, [w.encode("utf-8", "replace") for w in new])])
            self.sure = np.concatenate([self.sure, np.fromiter(map(detector.knows, new), bool, len(new))])


class Told(NamedTuple):
    """The lines of some texts, one after another: line k belongs to the text of number unit[k]; language -1: none."""

    unit: np.ndarray
    start: np.ndarray
    end: np.ndarray
    language: np.ndarray
    confidence: np.ndarray
    strong: np.ndarray
    whole: np.ndarray


def _tell(detector: Detector, texts: list[str], known: Known) -> Told:
    """The lines of the texts with language, confidence, strength, and whether they are whole (not cut at the start or the end)."""
    ends_of = sentence_ends(texts)
    n = np.array([len(e) for e in ends_of], np.int64)
    end = np.concatenate(ends_of) if len(ends_of) else np.zeros(0, np.int64)
    unit, last = np.repeat(np.arange(len(texts)), n), np.cumsum(n)
    start = np.zeros_like(end)
    start[1:] = end[:-1]
    start[(last - n)[n > 0]] = 0
    rows, strengths, row = [], [], known.row
    whole = np.ones(len(end), bool)
    for text, ends, after in zip(texts, ends_of, last.tolist()):
        if not len(ends):
            continue
        begin, line = 0, ""
        for stop in ends.tolist():
            line = text[begin:stop].strip()
            if begin == 0 and line[:1].islower():
                whole[after - len(ends)] = False
            begin = stop
            words, strong = prepared(line)
            strengths.append(strong)
            rows.append(row.setdefault(words, len(row)) if strong else -1)
        if not _STOP.search(line) and len(line) > 12 and not line.startswith(("#", "|", "-", "*")) and not text[begin:].strip(" "):
            whole[after - 1] = False
    known.add(detector)
    rows = np.array(rows, np.int64)
    has = np.flatnonzero(rows >= 0)
    has = has[known.sure[rows[has]]]
    language, confidence, strong = np.full(len(end), -1), np.zeros(len(end)), np.zeros(len(end), np.int64)
    strong[has] = np.array(strengths, np.int64)[has]
    language[has], confidence[has] = _with_context(known.p[rows[has]], unit[has], (end - start)[has], strong[has], len(texts))
    return Told(unit, start, end, language, confidence, strong, whole)


def _sums(at: np.ndarray, values: np.ndarray, shape: tuple[int, ...], first: float = 0.0) -> np.ndarray:
    """Sums of values by place, in order."""
    out = np.full(shape, first)
    np.add.at(out.reshape(-1), at.reshape(-1), values.reshape(-1))
    return out


def _with_context(p: np.ndarray, unit: np.ndarray, size: np.ndarray, strong: np.ndarray, units: int, doubt: float = 0.05) -> tuple[np.ndarray, np.ndarray]:
    """The lines' languages and confidences once more, given how much of the unit is in each language.

    A short line that could be either goes with the rest; a clear one stays.
    """
    k = np.arange(len(LANGUAGES))
    clear = strong == 2
    share = _sums(unit[clear, None] * len(k) + k, p[clear] * size[clear, None], (units, len(k)), 1e-9)
    # languages of one script share what the script has: only they can be taken for one another
    for script in SCRIPTS:
        share[:, script] /= share[:, script].sum(1, keepdims=True)
    q = p * (share[unit] + doubt)
    q /= q.sum(1, keepdims=True)
    best = q.argmax(1)
    return best, q[np.arange(len(q)), best]


def _summary(told: Told, cut_ends: np.ndarray, sure: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Unit, language, lines and confidence of the languages that each unit has, in order; cut_ends: for each unit."""
    shape = len(cut_ends), len(LANGUAGES)
    has = told.language >= 0
    unit, confidence, size, clear = told.unit[has], told.confidence[has], (told.end - told.start)[has], told.strong[has] == 2
    at = unit * shape[1] + told.language[has]
    counts = clear & (confidence >= sure) & (told.whole[has] | ~cut_ends[unit])
    n = _sums(at[counts], np.ones(counts.sum(), np.int64), shape).astype(np.int64)
    total = _sums(at[counts], size[counts], shape)
    weight = _sums(at[counts], confidence[counts] * size[counts], shape)
    # where nothing counts, the likeliest language of all lines
    loose = _sums(at, confidence * size * np.where(clear, 1, 0.2), shape)
    some = np.zeros(shape[0], bool)
    some[unit[clear]] = True
    rest = np.flatnonzero(~n.any(1) & loose.any(1) & some)
    best = loose[rest].argmax(1)
    n[rest, best], weight[rest, best], total[rest, best] = 1, loose[rest, best], loose[rest].sum(1)
    units, languages = np.nonzero(n)
    return units, languages, n[units, languages], weight[units, languages] / total[units, languages]


TOLD = T.StructType([
    T.StructField("unit_table", T.StringType()), T.StructField("unit_id", T.StringType()), T.StructField("label", T.StringType()),
    T.StructField("language", T.StringType()), T.StructField("n_lines", T.IntegerType()), T.StructField("confidence", T.DoubleType()), T.StructField("n_languages", T.IntegerType()),
])

STRETCH = T.StructType([
    T.StructField("unit_table", T.StringType()), T.StructField("unit_id", T.StringType()), T.StructField("start_char", T.IntegerType()), T.StructField("end_char", T.IntegerType()),
    T.StructField("language", T.StringType()), T.StructField("confidence", T.DoubleType()),
])

PART = 10_000


def _languages_of(batches: Iterator[pd.DataFrame], detector: Detector, sure: float) -> Iterator[pd.DataFrame]:
    known, codes = Known(), np.array(LANGUAGES, object)
    for pdf in batches:
        for a in range(0, len(pdf), PART):
            part = pdf.iloc[a : a + PART]
            units, languages, n, confidence = _summary(_tell(detector, part["text"].tolist(), known), part["is_piece"].to_numpy(bool), sure)
            out = {c: part[c].to_numpy()[units] for c in ("unit_table", "unit_id", "label")}
            out |= {"language": codes[languages], "n_lines": n.astype(np.int32), "confidence": confidence, "n_languages": np.bincount(units, minlength=len(part))[units].astype(np.int32)}
            yield pd.DataFrame(out)
            if len(known.row) > KNOWN:
                known = Known()


def _stretches_of(batches: Iterator[pd.DataFrame], detector: Detector) -> Iterator[pd.DataFrame]:
    known = Known()
    for pdf in batches:
        rows = []
        for a in range(0, len(pdf), PART):
            part = pdf.iloc[a : a + PART]
            texts = part["text"].tolist()
            told: list[list[tuple]] = [[] for _ in texts]
            for u, *line in zip(*(x.tolist() for x in _tell(detector, texts, known))):
                told[u].append(line)
            # lines that may change their language are labelled position by position
            mixed = [(u, n, text[start:end]) for u, (text, lines) in enumerate(zip(texts, told)) for n, (start, end, language, confidence, strong, _) in enumerate(lines) if language >= 0 and may_be_mixed(text[start:end], np.array([confidence]))]
            parts = {(u, n): own for (u, n, _), own in zip(mixed, line_parts(detector, [line for _, _, line in mixed])) if len({x[1] for x in own}) > 1}
            for u, (table, unit, text, lines) in enumerate(zip(part["unit_table"], part["unit_id"], texts, told)):
                own: list[list] = []
                pieces = []
                for n, (start, end, language, confidence, strong, _) in enumerate(lines):
                    last = start
                    for stop, code, sure in parts.get((u, n), [(end - start, language, confidence)]):
                        pieces.append((last, start + stop, code, sure, strong))
                        last = start + stop
                for start, end, language, confidence, strong in pieces:
                    if language < 0 or strong < 2 and own:
                        if own:
                            own[-1][1] = end
                    elif own and own[-1][2] == language:
                        own[-1][1], own[-1][3], own[-1][4] = end, own[-1][3] + confidence * (end - start), own[-1][4] + end - start
                    else:
                        own.append([own[-1][1] if own else 0, end, language, confidence * (end - start), end - start])
                if own:
                    own[-1][1] = len(text)
                rows += [(table, unit, s, e, LANGUAGES[k], w / max(1, n)) for s, e, k, w, n in own]
            if len(known.row) > KNOWN:
                known = Known()
        yield pd.DataFrame(rows, columns=[f.name for f in STRETCH.fields]).astype({"start_char": "int32", "end_char": "int32"})


def fit(labelled: DataFrame, train_docs: int = 1200, lines_each: int = 1500) -> Detector:
    """Train on a bounded sample of labelled rows (doc_id, text, lang)."""
    sample = labelled.select("doc_id", "text", language_label(F.col("lang")).alias("y")).where("y is not null and text is not null")
    # the ids first, so that no partition sends train_docs texts of its own
    chosen = sample.select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_docs)
    sample = sample.join(F.broadcast(chosen), "doc_id", "left_semi").collect()
    sample.sort(key=lambda r: (r["doc_id"], r["y"], r["text"]))
    lines: list[tuple[bytes, int]] = []
    count = [0] * len(LANGUAGES)
    texts = [r["text"] for r in sample]
    for r, ends in zip(sample, sentence_ends(texts)):
        y, start = LANGUAGES.index(r["y"]), 0
        for end in ends.tolist():
            words, strong = prepared(r["text"][start:end].strip())
            start = end
            if strong == 2 and count[y] < lines_each:
                lines.append((words.encode("utf-8", "replace"), y))
                count[y] += 1
    if not lines:
        raise ValueError("no labelled text to train on")
    model = train(lines, steps=150)
    p = line_probabilities(model, [b for b, _ in lines])
    agree = [(b, y) for (b, y), q in zip(lines, p) if not (q.argmax() != y and q.max() > 0.6)]
    vocabulary = {w for words in STOPWORDS.values() for w in words}
    for line, _ in agree:
        vocabulary.update(c for w in line.decode("utf-8", "replace").split() for c in (w if "぀" <= w[0] <= "鿿" else (w,)))
    return Detector(train(agree, steps=350, seed=8, model=model, rate=0.015, mixed=0.3), vocabulary)


def detect_languages(units: DataFrame, detector: Detector, sure: float = 0.75) -> DataFrame:
    """One row per language that a unit has; units: unit_table, unit_id, label, text, is_piece (cut out of a text, so that its ends may be cut)."""
    shared = units.sparkSession.sparkContext.broadcast(detector)
    units = units.select("unit_table", "unit_id", "label", "text", "is_piece").where("text is not null")
    return units.mapInPandas(lambda batches: _languages_of(batches, shared.value, sure), TOLD)


def language_stretches(units: DataFrame, detector: Detector) -> DataFrame:
    """The single-language stretches of each unit (unit_table, unit_id, text), in order, nothing left out."""
    shared = units.sparkSession.sparkContext.broadcast(detector)
    units = units.select("unit_table", "unit_id", "text").where("text is not null")
    return units.mapInPandas(lambda batches: _stretches_of(batches, shared.value), STRETCH)


def latest_guess(guesses: DataFrame) -> DataFrame:
    """chunk_id, label: the guess with the greatest guessed_at."""
    return guesses.groupBy("chunk_id").agg(F.max_by("language", F.struct(F.col("guessed_at").isNotNull(), "guessed_at", "confidence")).alias("label"))


def mislabelled(told: DataFrame) -> DataFrame:
    """Rows of units whose label is absent, unusable or wrong, or that hold several languages."""
    label = language_label(F.col("label"))
    return told.where(label.isNull() | (F.col("n_languages") > 1) | (label != F.col("language")))
