"""Personal data: fixed patterns, and a linear-chain conditional random field over word shapes.

The field is trained here, by gradient descent with forward-backward in numpy, on a small labelled table of
word runs (``labelled_runs``).  A word without a digit or an @ carries no label by definition, so the chain falls
apart at such words: each run between them is decoded by itself, from an unlabelled word to an unlabelled word, which
gives the best path of the whole text among those that leave such words unlabelled.  Runs are decoded by Viterbi in numpy,
all runs of a batch and length at once.
"""

from __future__ import annotations

import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import common as C

#: The kinds, in the order in which spans of one start are listed, and their patterns.
KINDS = ("email", "ip", "card", "phone")
EMAIL_TAIL = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
EMAIL_HEAD = re.compile(r"[A-Za-z0-9._%+-]")
#: A match starts where its digits start and ends where they end, so nothing is gained by starting or giving back inside a run of digits.
IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGITS = re.compile(r"[0-9]")
TRIGGER = re.compile(r"[0-9@]")
SPACES = frozenset("\x20\x09\x0a\x0b\x0c\x0d")
LABELS = ("O", *KINDS)
#: How many runs the labelled table has for each template, and the training's steps.
RUNS_PER_TEMPLATE, STEPS, RATE, DECAY = 60, 150, 0.2, 1e-3


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c)
        if i % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def pattern_spans(text: str) -> list[tuple[int, str, int]]:
    """(start, kind, end) of the fixed patterns, leftmost and without overlap within a kind; a match that fails its test is dropped without another try."""
    out, past = [], 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > past and EMAIL_HEAD.match(text[start - 1]):
            start -= 1
        m = EMAIL_TAIL.match(text, at) if start < at else None
        if m:
            out.append((start, "email", m.end()))
            past = m.end()
        at = text.find("@", max(at + 1, past))
    for m in IP.finditer(text):
        if all(len(g.lstrip("0")) <= 3 and int(g.lstrip("0") or 0) <= 255 for g in m.groups()):
            out.append((m.start(), "ip", m.end()))
    for m in CARD.finditer(text):
        digits = re.sub(r"[\x20-]", "", m[0])
        if 12 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), "card", m.end()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 9 <= len(DIGITS.findall(m[0])) <= 15:
                out.append((m.start(), "phone", m.end()))
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[1])))


def spelled(spans) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, kind, end in spans)


# --- the labelled table -----------------------------------------------------------------------------------------


def labelled_runs(per_template: int = RUNS_PER_TEMPLATE, seed: int = 11) -> list[tuple[list[str], list[str]]]:
    """The small labelled table: (words, labels) of runs, made from templates with a fixed seed. d is a digit, a a letter, n a number up to 255."""
    r = random.Random(seed)
    kinds = {
        "email": ["aaaa.aa@aaaaa.aaa", "aaadd@aaaa.aa", "aaaaa@aaaaaa.aa.aa", "a_aaaa@aa-aaa.aaa,", "aaaa+aa@aaaaad.aaa.", "<aaaaa@aaaa.aaa>"],
        "ip": ["n.n.n.n", "n.n.n.n,", "n.n.n.n:dddd", "(n.n.n.n)", "n.n.n.n."],
        "card": ["dddd dddd dddd dddd", "dddd-dddd-dddd-dddd", "dddddddddddddddd", "dddd dddddd ddddd", "dddddddddddddddd.", "dddd dddd dddd dddd,"],
        "phone": ["+d (ddd) ddd-dddd", "+dd ddd ddd dddd", "+dd dd dddddddd", "(ddd) ddd-dddd", "ddd-ddd-dddd", "+ddddddddddd", "(ddd) ddd-dddd,", "ddd.ddd.dddd.", "+dd-ddd-ddd-ddd."],
        "O": ["dddd", "d", "dd", "dd.", "ddd,", "d.d", "d.dd.d", "dd%", "$dd.dd", "dddd-dd-dd", "dd:dd", "dd/dd/dddd", "aad", "adda", "d,ddd", "d,ddd,ddd", "ddaa", "dddd-dddd", "@aaaaa", "aaa@", "d d", "dd ddd", "dddd dddd", "dddd.", "ddddd", "dddddd", "ddddddd", "AAd-dd", "[dd]", "(dddd)", "d.d.", "ddxdd", "adadadadadadadad", "dddd dd dd dd", "#dddd", "ddd ddd"],
    }
    fill = {"d": "0123456789", "a": "abcdefghijklmnopqrstuvwxyz", "A": "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}
    table = []
    for label, templates in kinds.items():
        for template in templates:
            for _ in range(per_template):
                text = "".join(str(r.randrange(256)) if c == "n" else r.choice(fill[c]) if c in fill else c for c in template)
                words = text.split(" ")
                tags = [label] * len(words)
                if r.random() < 0.15:  # two things side by side
                    other = r.choice(kinds["O"][:12])
                    more = "".join(r.choice(fill[c]) if c in fill else c for c in other).split(" ")
                    words, tags = (words + more, tags + ["O"] * len(more)) if r.random() < 0.5 else (more + words, ["O"] * len(more) + tags)
                table.append((words, tags))
    return table


# --- features ---------------------------------------------------------------------------------------------------

_CLASS = {**dict.fromkeys("0123456789", "d"), **dict.fromkeys("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ", "a")}


def word_shape(word: str) -> str:
    """Digits as d, letters as a, other characters as they are; runs once, except that runs of digits keep their length up to 6 (then +)."""
    out, i = [], 0
    while i < len(word):
        c = _CLASS.get(word[i], word[i] if word[i] < "\x80" else "u")
        j = i
        while j < len(word) and _CLASS.get(word[j], word[j] if word[j] < "\x80" else "u") == c:
            j += 1
        out.append(c + (str(min(j - i, 6)) if c == "d" else ""))
        i = j
    return "".join(out)


def features(words: list[str], k: int) -> list[str]:
    word = words[k]
    digits, shape = sum(c.isdigit() for c in word), word_shape(word)
    core = shape.strip(".,;:!?()[]<>\"'")
    loose = re.sub(r"d\d", "d", core)
    near = [re.sub(r"d\d", "d", word_shape(words[j])) if 0 <= j < len(words) else "_" for j in (k - 1, k + 1)]
    total = sum(sum(c.isdigit() for c in w) for w in words[max(0, k - 3) : k + 4])
    return ["1", "s:" + core, "l:" + loose, "n:" + str(min(digits, 20)), "t:" + str(min(total, 20)), "p:" + loose + "<" + near[0], "q:" + loose + ">" + near[1], "@" + str("@" in word and "." in word.partition("@")[2]), "+" + str(word[:1] == "+"), "(" + str(word[:1] == "("), "." + str(core.count("."))]


class Field:
    """A linear-chain conditional random field: emission weights by feature, and weights of label pairs. A run lies between two words with label 0, and the pairs with these count."""

    def __init__(self, table: list[tuple[list[str], list[str]]], steps: int = STEPS):
        names = sorted({f for words, _ in table for k in range(len(words)) for f in features(words, k)})
        self.index = {f: i for i, f in enumerate(names)}
        m = len(LABELS)
        self.emit = np.zeros((len(names), m))
        self.step = np.zeros((m, m))
        self.memory: dict[tuple, np.ndarray] = {}
        by_size = defaultdict(list)
        for words, tags in table:
            by_size[len(words)].append(([[self.index[f] for f in features(words, k)] for k in range(len(words))], [LABELS.index(t) for t in tags]))
        groups = [(np.array([x for x, _ in g]), np.array([y for _, y in g])) for _, g in sorted(by_size.items())]
        n, moment = len(table), [np.zeros_like(self.emit), np.zeros_like(self.step)]
        speed = [np.zeros_like(self.emit), np.zeros_like(self.step)]
        for t in range(1, steps + 1):
            slope = [-DECAY * self.emit, -DECAY * self.step]
            for x, y in groups:
                emit, step = self._gap(x, y)
                slope[0] += emit / n
                slope[1] += step / n
            for k, w in enumerate((self.emit, self.step)):  # Adam, uphill
                moment[k] = 0.9 * moment[k] + 0.1 * slope[k]
                speed[k] = 0.999 * speed[k] + 0.001 * slope[k] ** 2
                w += RATE * (moment[k] / (1 - 0.9**t)) / (np.sqrt(speed[k] / (1 - 0.999**t)) + 1e-8)

    def _gap(self, x: np.ndarray, y: np.ndarray):
        """Seen minus expected counts of emissions and label pairs: forward-backward over runs of one length."""
        n, size, _ = x.shape
        m = len(LABELS)
        score = self.emit[x].sum(2)
        ahead, back = np.zeros_like(score), np.zeros_like(score)
        ahead[:, 0] = score[:, 0] + self.step[0]
        back[:, -1] = self.step[:, 0]
        for k in range(1, size):
            ahead[:, k] = score[:, k] + np.logaddexp.reduce(ahead[:, k - 1, :, None] + self.step, axis=1)
        for k in range(size - 2, -1, -1):
            back[:, k] = np.logaddexp.reduce(self.step + (score[:, k + 1] + back[:, k + 1])[:, None, :], axis=2)
        whole = np.logaddexp.reduce(ahead[:, -1] + self.step[:, 0], axis=1)
        p = np.eye(m)[y] - np.exp(ahead + back - whole[:, None, None])
        emit, step = np.zeros_like(self.emit), np.zeros_like(self.step)
        np.add.at(emit, x.reshape(-1), np.repeat(p.reshape(-1, m), x.shape[2], axis=0))
        for k in range(1, size):
            pair = np.exp(ahead[:, k - 1, :, None] + self.step + (score[:, k] + back[:, k])[:, None, :] - whole[:, None, None])
            step -= pair.sum(0)
            np.add.at(step, (y[:, k - 1], y[:, k]), 1)
        step[0] += p[:, 0].sum(0)
        step[:, 0] += p[:, -1].sum(0)
        return emit, step

    def scores(self, words: list[str]) -> np.ndarray:
        out = np.zeros((len(words), len(LABELS)))
        for k in range(len(words)):
            out[k] = self.emit[[i for f in features(words, k) if (i := self.index.get(f)) is not None]].sum(0)
        return out

    def decode(self, runs: list[list[str]]) -> list[np.ndarray]:
        """The best labels of each run: Viterbi over all runs of a length together."""
        out: list = [None] * len(runs)
        by_size = defaultdict(list)
        for i, words in enumerate(runs):
            by_size[len(words)].append(i)
        for size, own in by_size.items():
            score = np.stack([self.scores(runs[i]) for i in own])
            best, came = score[:, 0] + self.step[0], []
            for k in range(1, size):
                reach = best[:, :, None] + self.step
                came.append(reach.argmax(1))
                best = reach.max(1) + score[:, k]
            path = np.zeros((len(own), size), np.int64)
            path[:, -1] = (best + self.step[:, 0]).argmax(1)
            for k in range(size - 1, 0, -1):
                path[:, k - 1] = came[k - 1][np.arange(len(own)), path[:, k]]
            for i, p in zip(own, path, strict=True):
                out[i] = p
        return out


def word_runs(text: str) -> list[list[tuple[int, int]]]:
    """(start, end) of the words with a digit or an @, in runs that no other word interrupts."""
    runs: list[list[tuple[int, int]]] = []
    past = -1
    for m in TRIGGER.finditer(text):
        if m.start() < past:
            continue
        start, end = m.start(), m.end()
        while start > max(past, 0) and text[start - 1] not in SPACES:
            start -= 1
        while end < len(text) and text[end] not in SPACES:
            end += 1
        if runs and not text[past:start].strip("\x20\x09\x0a\x0b\x0c\x0d"):
            runs[-1].append((start, end))
        else:
            runs.append([(start, end)])
        past = end
    return runs


EDGES = ".,;:!?()[]<>{}\"'"
#: What a decoded span must hold to count as its kind.
MAKES_SENSE = {"email": lambda s: "@" in s[1:-1], "ip": lambda s: s.count(".") == 3 and not re.search("[A-Za-z]", s), "card": lambda s: 12 <= len(DIGITS.findall(s)) <= 19 and not re.search("[A-Za-z]", s), "phone": lambda s: 7 <= len(DIGITS.findall(s)) <= 15 and not re.search("[A-Za-z]", s)}


def field_spans(text: str, runs: list[list[tuple[int, int]]], paths: list[np.ndarray], base) -> list[tuple[int, str, int]]:
    """Decoded spans, without punctuation at their ends, that touch no span of ``base``."""
    out = []
    for run, path in zip(runs, paths, strict=True):
        k = 0
        while k < len(run):
            j = k
            while j + 1 < len(run) and path[j + 1] == path[k]:
                j += 1
            if path[k]:
                kind, start, end = LABELS[path[k]], run[k][0], run[j][1]
                while start < end and text[start] in EDGES and not (text[start] == "(" and ")" in text[start:end]):
                    start += 1
                while end > start and text[end - 1] in EDGES:
                    end -= 1
                if end > start and MAKES_SENSE[kind](text[start:end]) and not any(a < end and start < b for a, _, b in base):
                    out.append((start, kind, end))
            k = j + 1
    return out


def find_pii(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", keep: tuple = (), field: Field | None = None) -> DataFrame:
    """A row for each document: ``keep`` columns, id, base (spans of the patterns) and spans (those and the field's), each an array of (start, kind, end).

    Offsets count code points, ends are exclusive. A null or empty text has no spans. Repeated ids are judged one by one.
    The field is trained on the driver from ``labelled_runs`` (a few thousand rows) and sent along; it does not grow with the input.
    """
    shared = docs.sparkSession.sparkContext.broadcast(field or Field(labelled_runs()))
    trigger = np.zeros(256, bool)
    trigger[[ord(c) for c in "0123456789@"]] = True
    names = [*keep, id_col, "base", "spans"]
    span = "array<struct<start: long, kind: string, end: long>>"
    kind_of = pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.string()), ("end", pa.int64())]))
    pack = lambda rows: pa.array([[{"start": a, "kind": k, "end": b} for a, k, b in r] for r in rows], kind_of)

    def search(batches):
        model = shared.value
        for batch in batches:
            texts = batch.column(len(keep) + 1)
            rows = len(texts)
            base, runs = [()] * rows, [()] * rows
            for at, buf, offsets in C.text_slices(texts):
                seen = np.concatenate(([0], np.cumsum(trigger[buf])))
                for r in np.flatnonzero(seen[offsets[1:]] > seen[offsets[:-1]]):
                    text = texts[at + int(r)].as_py()
                    base[at + r] = pattern_spans(text)
                    runs[at + r] = word_runs(text)
            paths = iter(model.decode([[texts_of(texts, r)[a:b] for a, b in run] for r in range(rows) for run in runs[r]]))
            spans = []
            for r in range(rows):
                if runs[r]:
                    more = field_spans(texts_of(texts, r), runs[r], [next(paths) for _ in runs[r]], base[r])
                    spans.append(sorted([*base[r], *more], key=lambda s: (s[0], KINDS.index(s[1]))))
                else:
                    spans.append(())
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(keep) + 1)), pack(base), pack(spans)], names)

    texts_of = lambda texts, r: texts[r].as_py()
    schema = ", ".join([*(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in [*keep, id_col]), f"base {span}", f"spans {span}"])
    return C.batched(docs).select(*keep, id_col, text_col).mapInArrow(search, schema)


def masked(text: str | None, spans) -> str | None:
    """The text with each span replaced by its kind in brackets; overlapping spans become one, named after the first."""
    if not text or not spans:
        return text
    out, at = [], 0
    for start, kind, end in spans:
        if start >= at:
            out += [text[at:start], f"[{kind.upper()}]"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def digest(spans) -> str:
    return hashlib.sha256(spelled(spans).encode()).hexdigest()


def masked_documents(docs: DataFrame, *, text_col: str = "text", field: Field | None = None) -> DataFrame:
    """docs with the same columns and rows, personal data in ``text_col`` replaced by the kind in brackets."""
    own = docs.columns
    names, text_col = [f"c{i}" for i in range(len(own))], f"c{own.index(text_col)}"  # no column's name can clash
    docs = docs.toDF(*names)
    found = find_pii(docs, id_col=text_col, text_col=text_col, keep=tuple(c for c in names if c != text_col), field=field)

    def mask(batches):
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text_col))
            spans = batch.column(batch.schema.get_field_index("spans"))
            touched = np.flatnonzero(np.asarray(spans.value_lengths().fill_null(0)) > 0)
            if len(touched):
                out = texts.to_pylist()
                for i in touched:
                    out[i] = masked(out[i], [(s["start"], s["kind"], s["end"]) for s in spans[int(i)].as_py()])
                texts = pa.array(out, texts.type)
            yield pa.RecordBatch.from_arrays([texts if c == text_col else batch.column(batch.schema.get_field_index(c)) for c in names], names)

    return found.select(*names, "spans").mapInArrow(mask, docs.schema).toDF(*own)
