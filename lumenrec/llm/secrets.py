"""Secret scan: fixed patterns plus a character convolutional network.

Base spans, always reported: ``assign`` (a key word, a separator, a value of six
or more characters), ``access`` (AKIA and 16 or more of A-Z0-9), ``hex`` (24 or
more of 0-9a-f), each leftmost and non-overlapping.

The network scores every candidate with its context.  A candidate is, by
definition, a base span, or a run of 16 or more of ``A-Za-z0-9+/_.=-`` that holds
a digit and a letter.  Candidates that no base span overlaps are reported as ``cnn`` where the
calibrated probability reaches the threshold.  A candidate longer than the
window is scored on overlapping windows that cover all of it; the highest counts.

The network (embedding, one convolution, two max pools, one output; numpy) is
trained on findings that ``labelled_findings`` writes by rule from a seed.  A
second fold of them sets Platt's calibration, a third one the threshold: the
highest that keeps ``recall`` of its positive findings.  Recall and false alarms
on a fourth fold are reported with the network (``held_out``).

Defined results: null text is empty and has no spans; equal texts have equal
spans; offsets are code points, end exclusive; an empty table gives no rows;
other columns are not read.
"""

from __future__ import annotations

import base64
import functools
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import quoted, text_or_empty

KINDS = ("assign", "access", "hex", "cnn")
_ASSIGN = re.compile(r"(?i:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.ASCII)
_ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")
_RUN = re.compile(r"[A-Za-z0-9+/_.=-]{16,}")
LEFT, BODY, RIGHT = 24, 64, 8
WIDTH = LEFT + BODY + RIGHT
_RUN_MAP = np.zeros(256, np.uint8)
for _c in b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-":
    _RUN_MAP[_c] = 1
_RUN_TABLE = _RUN_MAP.tobytes()
_RUN_MARK = b"\x01" * 16
_HEX_TABLE = bytes(c in b"0123456789abcdef" for c in range(256))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans of the fixed patterns.  Cheap tests first rule out most texts."""
    out = []
    low = text.lower()
    if any(w in low for w in _ASSIGN_WORDS):
        out += [("assign", m.start(), m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [("access", m.start(), m.end()) for m in _ACCESS.finditer(text) if len(m[0]) >= 20]
    if b"\x01" * 24 in text.encode("utf-8", "surrogatepass").translate(_HEX_TABLE):
        out += [("hex", m.start(), m.end()) for m in _HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def runs(text: str) -> list[tuple[int, int]]:
    """Long runs of key-like characters with a digit and a letter."""
    if _RUN_MARK not in text.encode("utf-8", "surrogatepass").translate(_RUN_TABLE):
        return []
    return [
        (m.start(), m.end())
        for m in _RUN.finditer(text)
        if re.search(r"[0-9]", m[0]) and re.search(r"[A-Za-z]", m[0])
    ]


# ---------------------------------------------------------------- the network

#: 0 padding, 1 other, then classes: exact characters matter only where they tell forms apart.
_CODES = np.ones(128, np.int64)
for _k, _c in enumerate("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_.=-:\"' \n,;()<>@&?"):
    _CODES[ord(_c)] = _k + 2
N_CODES = int(_CODES.max()) + 1


def windows(text: str, start: int, end: int) -> Iterator[np.ndarray]:
    """Code rows for a candidate: left context, up to BODY characters of it, right context."""
    for at in range(start, max(end - BODY // 2, start + 1), BODY // 2):
        stop = min(at + BODY, end)
        row = np.zeros(WIDTH, np.int64)
        for base, part in (
            (LEFT - min(LEFT, at), text[max(0, at - LEFT) : at]),
            (LEFT, text[at:stop]),
            (LEFT + BODY, text[stop : stop + RIGHT]),
        ):
            codes = np.fromiter((_CODES[ord(c)] if ord(c) < 128 else 1 for c in part), np.int64, len(part))
            row[base : base + len(codes)] = codes
        yield row


@dataclass
class Network:
    embed: np.ndarray  # (codes, e)
    kernel: np.ndarray  # (5 * e, f)
    shift: np.ndarray  # (f,)
    out: np.ndarray  # (2 * f,)
    bias: float = 0.0
    scale: float = 1.0
    move: float = 0.0
    threshold: float = 0.5
    held_out: tuple[float, float] = (0.0, 0.0)  # recall and share of false alarms

    def _columns(self, codes: np.ndarray) -> np.ndarray:
        e = self.embed[codes]
        view = np.lib.stride_tricks.sliding_window_view(e, 5, axis=1)  # (n, w-4, e, 5)
        return view.transpose(0, 1, 3, 2).reshape(len(codes), WIDTH - 4, -1)

    def logits(self, codes: np.ndarray) -> np.ndarray:
        out = []
        for k in range(0, len(codes), 256):
            h = np.maximum(self._columns(codes[k : k + 256]) @ self.kernel + self.shift, 0)
            pooled = np.concatenate([h[:, : LEFT - 2].max(1), h[:, LEFT - 2 :].max(1)], axis=1)
            out.append(pooled @ self.out + self.bias)
        return np.concatenate(out) if out else np.zeros(0)

    def probability(self, codes: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.scale * self.logits(codes) + self.move, -30, 30)))


def labelled_findings(n: int, seed: int) -> list[tuple[str, int, int, int]]:
    """(text, start, end, is_secret) findings written by rule; half are secrets."""
    rng = np.random.default_rng(seed)
    lower, upper, digit = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"

    def draw(alphabet: str, k: int) -> str:
        return "".join(alphabet[i] for i in rng.integers(0, len(alphabet), k))

    def between(a: int, b: int) -> int:
        return int(rng.integers(a, b + 1))

    def word() -> str:
        parts = ("th", "en", "er", "on", "re", "an", "ing", "tion", "ver", "ich", "ung", "que", "ment", "ado", "os", "la", "ta", "ou", "é", "ö")
        return "".join(parts[i] for i in rng.integers(0, len(parts), between(1, 4)))

    def ascii_word() -> str:
        return word().replace("é", "e").replace("ö", "o")

    def sentence() -> str:
        return " ".join(word() for _ in range(between(0, 7)))

    def token() -> str:
        b64 = upper + lower + digit + "+/"
        forms = (
            lambda: draw(b64, 40),
            lambda: "ghp_" + draw(upper + lower + digit, 36),
            lambda: f"xoxb-{draw(digit, 12)}-{draw(digit, 12)}-{draw(upper + lower + digit, 24)}",
            lambda: "AKIA" + draw(upper + digit, between(16, 20)),
            lambda: draw("0123456789abcdef", int(rng.choice([24, 32, 40, 64]))),
            lambda: "sk_live_" + draw(upper + lower + digit, between(24, 32)),
            lambda: ".".join(base64.urlsafe_b64encode(rng.bytes(between(12, 40))).decode().rstrip("=") for _ in range(3)),
            lambda: draw(upper + lower + digit, between(20, 48)),
            lambda: draw(upper + lower + digit + "_-", between(20, 44)),
            lambda: base64.b64encode(rng.bytes(between(15, 40))).decode(),
        )
        return forms[int(rng.integers(len(forms)))]()

    def plain() -> str:
        forms = (
            lambda: "/".join(ascii_word() for _ in range(between(2, 5))) + f"/{between(1, 9999)}",
            lambda: f"www.{ascii_word()}.example.com/{ascii_word()}/{between(1, 999)}",
            lambda: f"{between(1990, 2030)}-{between(1, 12):02d}-{between(1, 28):02d}-{ascii_word()}-{ascii_word()}",
            lambda: f"{ascii_word()}-{ascii_word()}-v{between(0, 20)}.{between(0, 20)}.{between(0, 99)}",
            lambda: "_".join(ascii_word() for _ in range(between(3, 6))) + f"_{between(1, 99)}",
            lambda: "".join(ascii_word().capitalize() for _ in range(between(4, 7))) + str(between(1, 99)),
            lambda: f"{ascii_word()}{ascii_word()}{ascii_word()}{ascii_word()}.{ascii_word()}{between(1, 999)}",
            lambda: f"IMG_{draw(digit, 8)}_{draw(digit, 6)}.jpg",
            lambda: f"{ascii_word()}.{ascii_word()}.{ascii_word()}={between(1, 99999)}",
            lambda: f"{'-' * between(10, 30)}{ascii_word()}{between(1, 9)}",
            lambda: f"{ascii_word()}{draw(digit, between(12, 18))}",
            lambda: "+".join(f"{ascii_word()}{between(0, 9)}" for _ in range(between(4, 8))),
        )
        while not (_RUN.fullmatch(made := forms[int(rng.integers(len(forms)))]()) and re.search("[A-Za-z]", made) and re.search("[0-9]", made)):
            pass
        return made

    keys = ("password", "secret", "token", "api_key", "Authorization: Bearer", "key", "access", "credential", "auth")
    out = []
    for i in range(n):
        bad = i % 2 == 0
        body = token() if bad else plain()
        lead = sentence()
        if rng.random() < (0.5 if bad else 0.05):
            lead += f" {keys[int(rng.integers(len(keys)))]}{('=', ': ', ' = ', ' ', ' \"')[int(rng.integers(5))]}"
        else:
            lead += (" ", "\n", "(", " https://", "")[int(rng.integers(5))] if not bad else (" ", "\n", " \"")[int(rng.integers(3))]
        out.append((f"{lead}{body} {sentence()}", len(lead), len(lead) + len(body), int(bad)))
    return out


@functools.lru_cache(1)
def trained(n: int = 8000, epochs: int = 5, recall: float = 0.98, seed: int = 11) -> Network:
    """The network, fitted in a few seconds; the same for the same parameters."""
    found = labelled_findings(n, seed)
    codes = np.stack([next(windows(t, s, e)) for t, s, e, _ in found])
    y = np.array([b for *_, b in found], np.float64)
    cut, tuned, checked = n * 6 // 10, n * 7 // 10, n * 85 // 100  # ends of the folds: fit, calibration, threshold; the rest reports
    rng = np.random.default_rng(seed)
    e, f = 8, 24
    par = {
        "embed": rng.normal(0, 0.3, (N_CODES, e)), "kernel": rng.normal(0, 0.2, (5 * e, f)),
        "shift": np.zeros(f), "out": rng.normal(0, 0.2, 2 * f), "bias": np.zeros(1),
    }
    m1 = {k: np.zeros_like(v) for k, v in par.items()}
    m2 = {k: np.zeros_like(v) for k, v in par.items()}
    step, split = 0, LEFT - 2
    for _ in range(epochs):
        order = rng.permutation(cut)
        for at in range(0, cut, 64):
            pick = order[at : at + 64]
            x, b = codes[pick], len(pick)
            net = Network(par["embed"], par["kernel"], par["shift"], par["out"])
            cols = net._columns(x)
            h = np.maximum(cols @ par["kernel"] + par["shift"], 0)
            left, body = h[:, :split], h[:, split:]
            il, ib = left.argmax(1), body.argmax(1) + split
            pooled = np.concatenate([left.max(1), body.max(1)], axis=1)
            g = (1 / (1 + np.exp(-(pooled @ par["out"] + par["bias"]))) - y[pick]) / b
            gp = g[:, None] * par["out"] * (pooled > 0)
            dh = np.zeros_like(h)
            rows, chan = np.arange(b)[:, None], np.arange(f)[None, :]
            dh[rows, il, chan] += gp[:, :f]
            dh[rows, ib, chan] += gp[:, f:]
            dcol = (dh @ par["kernel"].T).reshape(b, WIDTH - 4, 5, e)
            de = np.zeros((b, WIDTH, e))
            for k in range(5):
                de[:, k : k + WIDTH - 4] += dcol[:, :, k]
            dembed = np.zeros_like(par["embed"])
            np.add.at(dembed, x, de)
            grads = {
                "embed": dembed, "kernel": np.tensordot(cols, dh, axes=([0, 1], [0, 1])), "shift": dh.sum((0, 1)),
                "out": pooled.T @ g + 1e-4 * par["out"], "bias": np.array([g.sum()]),
            }
            step += 1
            for k, d in grads.items():
                m1[k] = 0.9 * m1[k] + 0.1 * d
                m2[k] = 0.999 * m2[k] + 0.001 * d * d
                par[k] = par[k] - 0.01 * (m1[k] / (1 - 0.9**step)) / (np.sqrt(m2[k] / (1 - 0.999**step)) + 1e-8)
    net = Network(par["embed"], par["kernel"], par["shift"], par["out"], float(par["bias"][0]))
    z, t = net.logits(codes[cut:tuned]), y[cut:tuned]
    for _ in range(400):  # Platt's two numbers by gradient descent
        g = 1 / (1 + np.exp(-np.clip(net.scale * z + net.move, -30, 30))) - t
        net.scale -= 0.05 * float((g * z).mean()) / max(1.0, float(np.abs(z).mean()))
        net.move -= 0.05 * float(g.mean())
    kept = np.sort(net.probability(codes[tuned:checked])[y[tuned:checked] == 1])
    net.threshold = float(kept[int(np.floor((1 - recall) * len(kept)))])
    found, truth = net.probability(codes[checked:]) >= net.threshold, y[checked:] == 1
    net.held_out = (float(found[truth].mean()), float(found[~truth].mean()))
    return net


# ---------------------------------------------------------------- the operator


def find(text: str, net: Network) -> list[tuple[str, int, int, float]]:
    """All spans of a text by start, then kind, each with the network's probability."""
    base = base_spans(text)
    found = [(k, s, e, True) for k, s, e in base]
    for s, e in runs(text):
        if not any(bs < e and s < be for _, bs, be in base):
            found.append(("cnn", s, e, False))
    if not found:
        return []
    best = np.zeros(len(found))
    owner: list[int] = []
    codes: list[np.ndarray] = []

    def flush():
        if codes:
            np.maximum.at(best, owner, net.probability(np.stack(codes)))
        owner.clear()
        codes.clear()

    for i, (_, s, e, _sure) in enumerate(found):
        for row in windows(text, s, e):  # a long candidate has many: only 512 at a time are held
            owner.append(i)
            codes.append(row)
            if len(codes) == 512:
                flush()
    flush()
    out = [(k, s, e, float(p)) for (k, s, e, sure), p in zip(found, best, strict=True) if sure or p >= net.threshold]
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


# ---------------------------------------------------------------- over tables


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, spans array<struct<kind, start, stop, probability>>) for every row."""
    rows = docs.select(F.col(quoted(id_col)).alias("id"), text_or_empty(quoted(text_col)).alias("t"))
    shared = docs.sparkSession.sparkContext.broadcast(trained())  # a fixed small network
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("stop", pa.int64()), ("probability", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = shared.value
        for batch in batches:
            out = [
                [{"kind": k, "start": s, "stop": e, "probability": p} for k, s, e, p in find(t.as_py(), net)]
                for t in batch.column(1)
            ]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, kind)], names=["id", "spans"])

    schema = f"id {rows.schema['id'].dataType.simpleString()}, spans array<struct<kind:string,start:bigint,stop:bigint,probability:double>>"
    return rows.mapInArrow(run, schema)


def redact(text: str, net: Network, mark: str = "[SECRET]") -> str:
    """The text with every (merged) span replaced by ``mark``."""
    out, at = [], 0
    merged: list[list[int]] = []
    for _, s, e, _p in find(text, net):
        if merged and s <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], e)
        else:
            merged.append([s, e])
    if not merged:
        return text
    for s, e in merged:
        out += [text[at:s], mark]
        at = e
    return "".join([*out, text[at:]])


def redact_secrets(docs: DataFrame, text_col: str = "text", chars_col: str = "n_chars") -> DataFrame:
    """Every row stays; secrets in the text are masked and ``chars_col``, where there, follows.

    Null texts stay null.
    """
    shared = docs.sparkSession.sparkContext.broadcast(trained())
    at = docs.columns.index(text_col)
    chars = docs.columns.index(chars_col) if chars_col in docs.columns else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = shared.value
        for batch in batches:
            before = batch.column(at).to_pylist()
            after = [t if t is None else redact(t, net) for t in before]
            columns = list(batch.columns)
            columns[at] = pa.array(after, batch.schema.field(at).type)
            if chars is not None:
                old = batch.column(chars).to_pylist()
                new = [n if a == b else len(b) for n, a, b in zip(old, before, after, strict=True)]
                columns[chars] = pa.array(new, batch.schema.field(chars).type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return docs.mapInArrow(run, docs.schema)
