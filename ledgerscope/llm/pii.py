"""Personal data by patterns and by a character-level BiLSTM with a CRF.

The patterns give the base spans: emails, IPv4 addresses, card numbers (Luhn) and
phone numbers, each kind on its own, leftmost first. The network adds spans that
the patterns miss: two card numbers that run together, phone numbers without
a plus sign, addresses written with ``[at]`` or ``[.]``.

Every character is one of a few dozen classes. An LSTM reads a window forwards and
another one backwards; their outputs feed a linear-chain CRF over outside, begin and
inside of each kind. It is trained in numpy (exact gradients, Adam) on labelled
spans: windows of a bounded sample of the corpus, labelled by the patterns'
shapes, and the same windows with rewritten spans set into them. Digits have
one class, so checks of arithmetic (Luhn, octets, number of digits) are made on
what the network finds, not learnt.

Every text is read from its first character to its last in windows that overlap by half.
A window is decoded unless no span in it could pass the exact checks, which need an at
sign, bracketed or not, or four digits; leaving it undecoded changes nothing. A
span cut by an inner window edge is left to the neighbour that holds it whole; then all spans of a document are reconciled at once, base spans first,
the others by the largest total confidence without overlaps.
"""

from __future__ import annotations

import bisect
import random
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ledgerscope.llm.store import share, with_fields

KINDS = ("email", "ip", "card", "phone")
SAMPLE = 300          # windows per kind, and as many without a span with and without digits
WINDOW, STRIDE, MARGIN = 128, 64, 48
TRAIN_LENGTH = 96
HIDDEN, EMBED = 24, 12
ROUNDS, BATCH, RATE = 10, 32, 0.02
CONFIDENT = 0.6
GROUP = 96            # windows decoded together
LABELS = 1 + 2 * len(KINDS)

AT = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
SPOT = re.compile(r"@|[\[({] ?(?:at|AT) ?[\])}]|[0-9](?:[^0-9\n]{0,3}[0-9]){3,}+")
EMAIL_WHOLE = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
AT_FORMS = re.compile(r"\s*[\[({] ?at ?[\])}]\s*|\s*@\s*", re.I)
AT_SIGN = re.compile(r"@|[\[({] ?at ?[\])}]", re.I)
DIGIT = re.compile(r"[0-9]")
DOT_FORMS = re.compile(r"\s*[\[({] ?(?:dot|\.) ?[\])}]\s*|\s*\.\s*", re.I)


# ---------------------------------------------------------------- patterns

def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if k % 2:
            d = 2 * d - 9 if d > 4 else 2 * d
        total += d
    return total % 10 == 0


def octets(parts: list[str]) -> bool:
    """Whether all numbers are at most 255, however many zeros they start with."""
    return all(len(p.lstrip("0")) < 4 and int(p.lstrip("0") or "0") < 256 for p in parts)


def digits_of(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def shapes(text: str) -> list[tuple[int, int, int, bool]]:
    """(kind, start, stop, whether the check holds) of all leftmost non-overlapping pattern matches of each kind."""
    out = []
    done = 0
    for m in AT.finditer(text):
        start = m.start()
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        if start < m.start():
            out.append((0, start, m.end(), True))
            done = m.end()
    for m in IP.finditer(text):
        out.append((1, m.start(), m.end(), octets(m[0].split("."))))
    for m in CARD.finditer(text):
        digits = digits_of(m[0]) if m.end() - m.start() < 40 else ""
        out.append((2, m.start(), m.end(), 13 <= len(digits) <= 19 and luhn(digits)))
    if "+" in text:
        for m in PHONE.finditer(text):
            out.append((3, m.start(), m.end(), 9 <= len(digits_of(m[0])) <= 15))
    return out


def plausible(kind: int, text: str) -> bool:
    """Exact check of what the network found."""
    digits = digits_of(text)
    if kind == 0:
        return EMAIL_WHOLE.fullmatch(DOT_FORMS.sub(".", AT_FORMS.sub("@", text))) is not None
    if kind == 1:
        parts = DOT_FORMS.sub(".", text).split(".")
        return len(parts) == 4 and all(p and digits_of(p) == p and len(p) < 4 for p in parts) and octets(parts)
    if kind == 2:
        return 13 <= len(digits) <= 19 and luhn(digits) and not text.strip("0123456789 .-") and text[0] in "0123456789"
    marks = len(re.findall(r"[ ().-]+", text))
    return 9 <= len(digits) <= 15 and not text.strip("0123456789 ().+-") and (
        marks >= 2 or text[0] in "+(" or text.startswith("00")) and text.count("(") == text.count(")")


# ---------------------------------------------------------------- network

def character_classes() -> np.ndarray:
    """Class of each code point below 128: letters without case, one class for digits, each sign its own; 0 is padding."""
    out = np.zeros(128, np.int64)
    for c in range(128):
        ch = chr(c)
        if "a" <= ch.lower() <= "z":
            out[c] = 1 + ord(ch.lower()) - 97
        elif "0" <= ch <= "9":
            out[c] = 27
        elif ch in "\n\r":
            out[c] = 28
        elif ch.isspace() or c < 32 or c == 127:
            out[c] = 29
        else:
            out[c] = 32 + "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~".index(ch)
    return out


CLASSES = character_classes()
N_CLASSES = 32 + 32


def coded(text: str) -> np.ndarray:
    """Classes of the code points of a text."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    out = np.full(len(points), 30, np.int64)
    plain = points < 128
    out[plain] = CLASSES[points[plain]]
    out[(points >= 0x2000) & (points < 0x3000) | (points > 0xFFFF)] = 31
    return out


def sigmoid(x):
    return 0.5 * np.tanh(0.5 * x) + 0.5


def allowed() -> np.ndarray:
    """Which label may follow which: the inside of a kind only its begin or inside."""
    ok = np.ones((LABELS, LABELS), bool)
    for k in range(len(KINDS)):
        ok[:, 2 + 2 * k] = False
        ok[[1 + 2 * k, 2 + 2 * k], 2 + 2 * k] = True
    return ok


FORBIDDEN = np.where(allowed(), 0.0, -30.0).astype(np.float32)


class Tagger:
    """Embedding, two LSTMs, output layer and CRF transitions."""

    def __init__(self, seed: int = 7, hidden: int = HIDDEN, dtype=np.float32):
        rng = np.random.default_rng(seed)
        h, d = hidden, EMBED

        def normal(*shape):
            return rng.normal(0, 1 / np.sqrt(shape[-2]), shape).astype(dtype)

        self.p = {"embed": rng.normal(0, 0.5, (N_CLASSES, d)).astype(dtype), "wx": normal(2, d, 4 * h), "wh": normal(2, h, 4 * h),
                  "b": np.zeros((2, 1, 4 * h), dtype), "wo": normal(2 * h, LABELS), "bo": np.zeros(LABELS, dtype),
                  "trans": np.zeros((LABELS, LABELS), dtype)}
        self.p["b"][:, :, h:2 * h] = 1.0  # forget gates start open
        self.p["bo"][0] = 2.0

    def emissions(self, x: np.ndarray, keep: bool = False):
        """Label scores (T, B, labels) of windows x (B, T); with ``keep`` also what the gradient needs."""
        p = self.p
        h = p["wh"].shape[1]
        e = p["embed"][x.T]
        both = np.stack([e, e[::-1]])
        gx = both @ p["wx"][:, None] + p["b"][:, None]
        t_max, n = x.shape[1], x.shape[0]
        out = np.empty((2, t_max, n, h), e.dtype)
        state, cell = np.zeros((2, n, h), e.dtype), np.zeros((2, n, h), e.dtype)
        saved = []
        for t in range(t_max):
            z = gx[:, t] + state @ p["wh"]
            gates = sigmoid(z[..., :3 * h])
            g = np.tanh(z[..., 3 * h:])
            before = cell
            cell = gates[..., h:2 * h] * cell + gates[..., :h] * g
            tc = np.tanh(cell)
            if keep:
                saved.append((state, before, gates, g, tc))
            state = gates[..., 2 * h:] * tc
            out[:, t] = state
        top = np.concatenate([out[0], out[1, ::-1]], axis=2)
        scores = top @ p["wo"] + p["bo"]
        return (scores, (both, saved, top)) if keep else scores

    def chain(self, scores: np.ndarray, lengths: np.ndarray):
        """Forward and backward messages (probabilities scaled per step) and the log partition of each window."""
        t_max, n, k = scores.shape
        move = np.exp((self.p["trans"] + FORBIDDEN).astype(np.float64))
        top = scores.max(axis=2, keepdims=True)
        emit = np.exp((scores - top).astype(np.float64))
        live = np.arange(t_max)[:, None] < lengths[None, :]
        alpha, beta = np.empty((t_max, n, k)), np.ones((t_max, n, k))
        log_z = np.zeros(n)
        a = np.ones((n, k)) * np.exp(FORBIDDEN[0])  # a window starts as if after an outside label
        for t in range(t_max):
            now = emit[t] * (a if t == 0 else a @ move)
            size = now.sum(axis=1, keepdims=True)
            now /= size
            on = live[t]
            log_z += np.where(on, np.log(size[:, 0]) + top[t, :, 0], 0.0)
            a = np.where(on[:, None], now, a) if t else now
            alpha[t] = a
        b = np.ones((n, k))
        for t in range(t_max - 2, -1, -1):
            now = (emit[t + 1] * b) @ move.T
            now /= now.sum(axis=1, keepdims=True)
            b = np.where(live[t + 1][:, None], now, 1.0)
            beta[t] = b
        return alpha, beta, log_z, emit, move, live

    def loss_and_gradient(self, x: np.ndarray, y: np.ndarray, lengths: np.ndarray):
        """Mean negative log likelihood of the labels y (B, T), and its gradient by parameter."""
        p = self.p
        scores, (both, saved, top) = self.emissions(x, keep=True)
        t_max, n, k = scores.shape
        alpha, beta, log_z, emit, move, live = self.chain(scores, lengths)
        gold = y.T
        grid = np.arange(n)
        own = scores[np.arange(t_max)[:, None], grid[None, :], gold]
        steps = (p["trans"] + FORBIDDEN)[gold[:-1], gold[1:]]
        right = (own * live).sum() + (steps * live[1:]).sum() + FORBIDDEN[0][gold[0]].sum()
        loss = (log_z.sum() - right) / n
        mass = alpha * beta
        mass /= mass.sum(axis=2, keepdims=True)
        d_scores = mass
        d_scores[np.arange(t_max)[:, None], grid[None, :], gold] -= 1
        d_scores *= live[:, :, None] / n
        pair = alpha[:-1, :, :, None] * move * (emit[1:] * beta[1:])[:, :, None, :]
        pair *= (live[1:] / pair.sum(axis=(2, 3)))[:, :, None, None]
        d_trans = pair.sum(axis=(0, 1))
        np.add.at(d_trans, (gold[:-1][live[1:]], gold[1:][live[1:]]), -1)
        d_scores = d_scores.astype(scores.dtype)
        h = p["wh"].shape[1]
        grad = {"trans": (d_trans / n).astype(scores.dtype), "bo": d_scores.sum(axis=(0, 1)),
                "wo": (top.transpose(0, 2, 1) @ d_scores).sum(axis=0)}
        d_top = d_scores @ p["wo"].T
        d_out = np.stack([d_top[..., :h], d_top[::-1, :, h:]])
        d_z = np.empty((2, t_max, n, 4 * h), scores.dtype)
        d_state, d_cell = np.zeros((2, n, h), scores.dtype), np.zeros((2, n, h), scores.dtype)
        back = p["wh"].transpose(0, 2, 1)
        for t in range(t_max - 1, -1, -1):
            state, before, gates, g, tc = saved[t]
            i, f, o = gates[..., :h], gates[..., h:2 * h], gates[..., 2 * h:]
            d_h = d_out[:, t] + d_state
            d_c = d_cell + d_h * o * (1 - tc * tc)
            z = d_z[:, t]
            z[..., :h] = d_c * g * i * (1 - i)
            z[..., h:2 * h] = d_c * before * f * (1 - f)
            z[..., 2 * h:3 * h] = d_h * tc * o * (1 - o)
            z[..., 3 * h:] = d_c * i * (1 - g * g)
            d_state = z @ back
            d_cell = d_c * f
        states = np.stack([s[0] for s in saved], axis=1)
        # one small product per step: large ones would start as many threads as the machine has cores
        grad["wh"] = (states.transpose(0, 1, 3, 2) @ d_z).sum(axis=1)
        grad["wx"] = (both.transpose(0, 1, 3, 2) @ d_z).sum(axis=1)
        grad["b"] = d_z.sum(axis=(1, 2))[:, None]
        d_in = d_z @ p["wx"].transpose(0, 2, 1)[:, None]
        d_e = d_in[0] + d_in[1, ::-1]
        grad["embed"] = np.zeros_like(p["embed"])
        np.add.at(grad["embed"], x.T.reshape(-1), d_e.reshape(-1, EMBED))
        return loss, grad

    def train(self, windows: list[tuple[np.ndarray, np.ndarray]], rounds: int = ROUNDS, seed: int = 3) -> None:
        """Adam over shuffled batches with a falling rate."""
        rng = np.random.default_rng(seed)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v = {k: np.zeros_like(v) for k, v in self.p.items()}
        step, steps = 0, rounds * -(-len(windows) // BATCH)
        for _ in range(rounds):
            for at in np.array_split(rng.permutation(len(windows)), max(1, -(-len(windows) // BATCH))):
                x, y, lengths = padded([windows[k] for k in at])
                _, grad = self.loss_and_gradient(x, y, lengths)
                norm = np.sqrt(sum(float((g * g).sum()) for g in grad.values()))
                step += 1
                rate = RATE * (1 - 0.95 * step / steps)
                for k, g in grad.items():
                    g = g * min(1.0, 5.0 / (norm + 1e-9))
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v[k] = 0.99 * v[k] + 0.01 * g * g
                    self.p[k] -= (rate * (m[k] / (1 - 0.9 ** step)) / (np.sqrt(v[k] / (1 - 0.99 ** step)) + 1e-8)).astype(self.p[k].dtype)

    def decode(self, x: np.ndarray, lengths: np.ndarray):
        """Best label path (B, T) of each window and the marginal probability of each label on it."""
        scores = self.emissions(x)
        t_max, n, k = scores.shape
        alpha, beta, _, _, _, _ = self.chain(scores, lengths)
        mass = alpha * beta
        mass /= mass.sum(axis=2, keepdims=True)
        trans = self.p["trans"] + FORBIDDEN
        best = scores[0] + FORBIDDEN[0]
        back = np.zeros((t_max, n, k), np.int8)
        for t in range(1, t_max):
            ways = best[:, :, None] + trans
            back[t] = ways.argmax(axis=1)
            now = np.take_along_axis(ways, back[t][:, None, :].astype(np.int64), axis=1)[:, 0] + scores[t]
            on = (t < lengths)[:, None]
            back[t] = np.where(on, back[t], np.arange(k, dtype=np.int8))
            best = np.where(on, now, best)
        path = np.zeros((n, t_max), np.int64)
        path[:, -1] = best.argmax(axis=1)
        for t in range(t_max - 1, 0, -1):
            path[:, t - 1] = back[t][np.arange(n), path[:, t]]
        sure = np.take_along_axis(mass.transpose(1, 0, 2), path[:, :, None], axis=2)[:, :, 0]
        return path, sure


def padded(windows: list[tuple[np.ndarray, np.ndarray]]):
    lengths = np.array([len(x) for x, _ in windows])
    x = np.zeros((len(windows), int(lengths.max())), np.int64)
    y = np.zeros_like(x)
    for k, (a, b) in enumerate(windows):
        x[k, :len(a)], y[k, :len(b)] = a, b
    return x, y, lengths


# ---------------------------------------------------------------- labelled spans

def write_email(rng: random.Random) -> str:
    word = lambda a, b: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(a, b)))
    local = rng.choice([word(2, 9), word(1, 1) + "." + word(3, 8), word(3, 6) + str(rng.randrange(100)), word(2, 5) + "_" + word(2, 5),
                        str(rng.randrange(100))])
    host = [rng.choice([word(3, 9), "mail" + str(rng.randrange(10))])] + ([rng.choice(["example", word(3, 7)])] if rng.random() < 0.6 else [])
    tail = rng.choice(["com", "org", "net", "de", "fr", "es", "io"])
    at, dot = rng.choice([("@", "."), ("@", "."), (" @ ", " . "), (" [at] ", " [dot] "), ("(at)", "(dot)"), (" (at) ", "."), ("[at]", "."),
                          ("{at}", "{dot}"), ("@", " . ")])
    return local + at + dot.join([*host, tail])


def write_ip(rng: random.Random) -> str:
    parts = [str(rng.randrange(256)) for _ in range(4)]
    return rng.choice([".", ".", "[.]", "(.)", " . ", "[dot]", "(dot)"]).join(parts)


def write_card(rng: random.Random) -> str:
    some = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    if rng.random() < 0.4:
        return some(rng.choice([16, 16, 16, 15, 13, 19]))
    sign = rng.choice([" ", "-", ".", " - ", "  "])
    return sign.join(some(n) for n in rng.choice([(4, 4, 4, 4), (4, 4, 4, 4), (4, 6, 5)]))


def write_phone(rng: random.Random) -> str:
    some = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    return rng.choice([
        lambda: f"+1 ({some(3)}) {some(3)}-{some(4)}", lambda: f"+{some(2)} {some(3)} {some(3)} {some(4)}", lambda: f"({some(3)}) {some(3)}-{some(4)}",
        lambda: f"{some(3)}-{some(3)}-{some(4)}", lambda: f"{some(3)}.{some(3)}.{some(4)}", lambda: f"1 ({some(3)}) {some(3)}-{some(4)}",
        lambda: f"00{some(2)} {some(3)} {some(3)} {some(3)}", lambda: f"+{some(11)}", lambda: f"({some(3)}){some(3)}.{some(4)}"])()


def write_other(rng: random.Random) -> str:
    """Signs and numbers that are no personal data."""
    some = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    return rng.choice([
        lambda: f"20{some(2)}-0{rng.randint(1, 9)}-{some(2)}", lambda: f"{some(2)}:{some(2)}:{some(2)}", lambda: f"v{some(1)}.{some(1)}.{some(2)}",
        lambda: f"{some(1)},{some(3)},{some(3)}.{some(2)}", lambda: some(rng.randint(1, 12)), lambda: some(rng.randint(21, 40)),
        lambda: "".join(rng.choice("0123456789abcdef") for _ in range(rng.choice([32, 40, 64]))), lambda: f"{some(1)}.{some(5)}", lambda: f"#{some(5)}",
        lambda: f"20{some(2)}-0{rng.randint(1, 9)}-{some(2)} {some(2)}:{some(2)}:{some(2)}", lambda: f"{some(2)}/{some(2)}/20{some(2)}",
        lambda: f"{some(3)} {some(2)} {some(1)} {some(3)}", lambda: f"@{rng.choice(['home', 'all', 'x'])}", lambda: f"{some(2)}.{some(2)}.{some(4)}",
        lambda: f"{some(1)}.{some(1)}.{some(1)}", lambda: f"19{some(2)}-20{some(2)}", lambda: f"a @ {some(1)}.{some(2)} each", lambda: f"({some(4)})",
        lambda: f"{some(2)}, {some(2)}, {some(3)}, {some(4)}", lambda: f"{some(3)}-{some(1)}-{some(2)}-{some(6)}-{some(1)}"])()


WRITERS = (write_email, write_ip, write_card, write_phone)


def labels_of(length: int, spans: list[tuple[int, int, int]]) -> np.ndarray:
    y = np.zeros(length, np.int64)
    for kind, start, stop in spans:
        y[start] = 1 + 2 * kind
        y[start + 1:stop] = 2 + 2 * kind
    return y


def training_windows(sample: list[tuple[str, list[tuple[int, int, int]]]], seed: int = 1) -> list[tuple[np.ndarray, np.ndarray]]:
    """The sample's windows as they are, and with rewritten spans or other numbers set into them."""
    rng = random.Random(seed)
    out = []
    contexts = sample or [("", [])]
    for text, spans in sample:
        out.append((coded(text), labels_of(len(text), spans)))
    for k in range(max(len(contexts), 2000)):
        text, spans = contexts[k % len(contexts)]
        base = "" if spans else text
        if spans:  # the text before the first span or behind the last one
            base = max(text[:spans[0][1]], text[spans[-1][2]:], key=len)
        if digits_of(base):
            base = re.sub(r"[0-9]", "", base)
        gaps = [m.start() for m in re.finditer(" ", base)] or [0]
        at = rng.choice(gaps)
        marks, pieces, length = [], [base[:at], " " if at else ""], at + (1 if at else 0)
        for _ in range(rng.choice([1, 1, 1, 2, 2, 3])):
            kind = rng.choices(range(5), (4, 1, 2, 2, 3))[0]
            piece = WRITERS[kind](rng) if kind < 4 else write_other(rng)
            again = 2 if kind == 2 and rng.random() < 0.4 else 1
            for _ in range(again):
                if kind < 4:
                    marks.append((kind, length, length + len(piece)))
                sign = rng.choice([" ", " ", ", ", ". ", "### ", "!! ", "\n"]) if again == 1 else " "
                pieces += [piece, sign]
                length += len(piece) + len(sign)
        whole = "".join(pieces) + base[at:].lstrip()
        shift = max(0, min(at - rng.randrange(8, 40), len(whole) - TRAIN_LENGTH))
        stop = max([e for _, _, e in marks], default=0)
        shift = min(shift, min([s for _, s, _ in marks], default=shift))
        whole = whole[shift:max(shift + TRAIN_LENGTH, stop)]
        out.append((coded(whole), labels_of(len(whole), [(k_, s - shift, e - shift) for k_, s, e in marks])))
    return [w for w in out if len(w[0])]


def labelled_window(text: str, kind: int | None, start: int, stop: int, spans) -> tuple[int, str, list] | None:
    """A window around [start, stop) that cuts no span, with the spans inside it."""
    turn = zlib.crc32(text[start:stop].encode("utf-8", "surrogatepass")) % 40
    low, high = max(0, start - 16 - turn), min(len(text), max(stop, start - 16 - turn + TRAIN_LENGTH))
    for _, s, e in spans:
        if s < low < e:
            low = e
        if s < high < e:
            high = s
    if low > start or high < stop:
        return None
    inside = [(k, s - low, e - low) for k, s, e in spans if s >= low and e <= high]
    return -1 if kind is None else kind, text[low:high], inside


def sample_windows(documents: DataFrame, per_kind: int = SAMPLE) -> list[tuple[str, list[tuple[int, int, int]]]]:
    """A bounded sample of distinct windows per kind, by hash: spans by shape, numbers that are none, and plain text."""

    def run(batches):
        for b in batches:
            out = []
            for text in b.column("text").to_pylist():
                if not text:
                    continue
                found = [(k, s, e) for k, s, e, ok in shapes(text)
                         if ok or k == 2 and 13 <= len(digits_of(text[s:e])) <= 19] if SPOT.search(text) else []
                found.sort(key=lambda x: (x[1], -x[2]))
                spans, last = [], 0
                for k, s, e in found:
                    if s >= last and e - s <= TRAIN_LENGTH:
                        spans.append((k, s, e))
                        last = e
                for k, s, e in spans[:64]:
                    out.append(labelled_window(text, k, s, e, spans))
                if not spans:
                    m = SPOT.search(text)
                    start = m.start() if m else zlib.crc32(text.encode("utf-8", "surrogatepass")) % len(text)
                    out.append(labelled_window(text, 4 if m else 5, start, min(start + 8, len(text)), []))
            out = [x for x in out if x is not None]
            yield pa.RecordBatch.from_pylist(
                [{"kind": k, "part": t, "spans": [{"kind": a, "start": s, "stop": e} for a, s, e in spans]} for k, t, spans in out],
                pa.schema([("kind", pa.int32()), ("part", pa.string()),
                           ("spans", pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("stop", pa.int32())])))]))

    windows = documents.select("text").where("text IS NOT NULL AND text <> ''").mapInArrow(
        run, "kind int, part string, spans array<struct<kind:int,start:int,stop:int>>")
    key = F.xxhash64("part")
    windows = windows.groupBy(key.alias("h")).agg(F.min("kind").alias("kind"), F.min_by(F.struct("part", "spans"), "part").alias("w"))
    place = F.row_number().over(Window.partitionBy("kind").orderBy("h"))
    got = windows.withColumn("place", place).where(F.col("place") <= per_kind).orderBy("kind", "h").select("w.*").collect()
    return [(r.part, [(s.kind, s.start, s.stop) for s in r.spans]) for r in got]


def learn_tagger(documents: DataFrame) -> Tagger:
    """Network fitted on the corpus's labelled windows."""
    tagger = Tagger()
    tagger.train(training_windows(sample_windows(documents)))
    return tagger


# ---------------------------------------------------------------- spans of documents

def may_pass(text: str) -> bool:
    """Whether any stretch of ``text`` could be ``plausible``: emails need an at sign in one of its forms, all other kinds four digits."""
    return AT_SIGN.search(text) is not None or len(DIGIT.findall(text)) >= 4


def windows_of(low: int, high: int) -> list[tuple[int, int]]:
    """Windows that cover [low, high) and overlap by half."""
    if high - low <= WINDOW:
        return [(low, high)]
    starts = [*range(low, high - WINDOW, STRIDE), high - WINDOW]
    return [(s, s + WINDOW) for s in starts]


def spans_of_path(path: np.ndarray, sure: np.ndarray, length: int) -> list[tuple[int, int, int, float]]:
    """(kind, start, stop, confidence) of the spans on a label path."""
    out, at = [], 0
    hot = np.flatnonzero(path[:length])
    done = -1
    for at in hot.tolist():
        if at <= done:
            continue
        kind = (int(path[at]) - 1) // 2
        stop = at + 1
        while stop < length and path[stop] == 2 + 2 * kind:
            stop += 1
        out.append((kind, at, stop, float(sure[at:stop].min())))
        done = stop - 1
    return out


def reconcile(base: list[tuple[int, int, int]], found: dict[tuple[int, int, int], float]) -> list[tuple[int, int, int]]:
    """The found spans with the largest total confidence that overlap neither one another nor a base span."""
    edges = sorted((s, e) for _, s, e in base)
    merged: list[list[int]] = []
    for s, e in edges:
        if merged and s < merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], e)
        else:
            merged.append([s, e])
    starts = [s for s, _ in merged]
    free = []
    for (kind, s, e), sure in found.items():
        k = bisect.bisect_left(starts, e) - 1
        if k < 0 or merged[k][1] <= s:
            free.append((e, s, kind, sure))
    free.sort()
    ends = [f[0] for f in free]
    best, take = [0.0], []
    for k, (_, s, _, sure) in enumerate(free):
        before = bisect.bisect_right(ends, s, 0, k)
        use = best[before] + sure
        take.append((use > best[k], before))
        best.append(max(use, best[k]))
    out, k = [], len(free)
    while k:
        used, before = take[k - 1]
        if used:
            out.append((free[k - 1][2], free[k - 1][1], free[k - 1][0]))
            k = before
        else:
            k -= 1
    return out


def find_spans(texts: list[str], tagger: Tagger) -> list[list[tuple[int, int, int, bool]]]:
    """(kind, start, stop, base) of each text, by kind and start."""
    base = [[(k, s, e) for k, s, e, ok in shapes(t) if ok] for t in texts]
    found: list[dict] = [{} for _ in texts]
    queue = []

    def work():
        x = np.zeros((len(queue), max(e - s for _, s, e, _, _ in queue)), np.int64)
        for k, (d, s, e, _, _) in enumerate(queue):
            x[k, :e - s] = coded(texts[d][s:e])
        lengths = np.array([e - s for _, s, e, _, _ in queue])
        paths, sure = tagger.decode(x, lengths)
        for k, (d, s, e, low, high) in enumerate(queue):
            for kind, a, z, p in spans_of_path(paths[k], sure[k], e - s):
                cut = a == 0 and s > low or z == e - s and e < high
                if not cut and p >= CONFIDENT and plausible(kind, texts[d][s + a:s + z]):
                    key = kind, s + a, s + z
                    found[d][key] = max(p, found[d].get(key, 0.0))
        queue.clear()

    for d, text in enumerate(texts):
        for s, e in windows_of(0, len(text)):
            if may_pass(text[s:e]):
                queue.append((d, s, e, 0, len(text)))
                if len(queue) == GROUP:
                    work()
    if queue:
        work()
    return [sorted([(*b, True) for b in base[d]] + [(*a, False) for a in reconcile(base[d], found[d])]) for d in range(len(texts))]


def may_hold(column: pa.Array) -> np.ndarray:
    """Rows whose text has a digit or an at sign, or a bracketed one."""
    import pyarrow.compute as pc
    return pc.match_substring_regex(column, r"@|[0-9]|(?i:[\[({] ?at ?[\])}])").fill_null(False).to_numpy(zero_copy_only=False)


def find_personal_data(documents: DataFrame, tagger: Tagger, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, the columns of ``keep`` and spans (kind, start, stop in code points, base) of every row.

    Defined cases: a null or empty text has no spans; repeated rows are read
    one by one; kinds may overlap among base spans, added ones overlap
    nothing; other columns are ignored.
    """
    names = ["doc_id", *[c for c in keep if c != "doc_id"]]
    shared = share(documents.sparkSession, tagger)
    span = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("stop", pa.int64()), ("base", pa.bool_())])

    def run(batches):
        model = shared()
        for b in batches:
            column = b.column("__text")
            rows = np.flatnonzero(may_hold(column))
            out: list[list] = [[] for _ in range(b.num_rows)]
            for at in range(0, len(rows), 64):
                part = rows[at:at + 64]
                got = find_spans(column.take(pa.array(part)).to_pylist(), model)
                for r, spans in zip(part.tolist(), got):
                    out[r] = [{"kind": KINDS[k], "start": s, "stop": e, "base": base} for k, s, e, base in spans]
            yield pa.RecordBatch.from_pydict({c: b.column(c) for c in names} | {"spans": pa.array(out, pa.list_(span))})

    return documents.select(*names, F.col("text").alias("__text")).mapInArrow(run, with_fields(
        documents.select(*names).schema, "spans array<struct<kind:string,start:bigint,stop:bigint,base:boolean>>"))


def spelled(spans: Column) -> Column:
    """``kind:start:end`` of spans already in order, comma-joined."""
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))))


def pii_query(spark, sf_dir: str) -> DataFrame:
    """op11: personal data of every document."""
    from ledgerscope.sources.tables import read_table
    documents = read_table(spark, sf_dir, "documents")
    out = find_personal_data(documents, learn_tagger(documents))
    base = F.filter("spans", lambda s: s["base"])

    def number(kind: str) -> Column:
        return F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")

    return out.select("doc_id", *[number(k) for k in KINDS], F.sha2(spelled(base), 256).alias("base_sha256"),
                      spelled(F.col("spans")).alias("spans"))
