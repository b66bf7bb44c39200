"""Personal data by a skip-chain conditional random field.

Patterns find the plain cases. The field works on the tokens that hold a digit or an @, and on groups of short numbers
set apart by spaces: their shapes give unary potentials, neighbours share chain potentials, and tokens of one document
that repeat or resemble each other (same normal form, or the same last seven digits) share skip potentials, however far
apart. Tokens inside pattern matches are strong evidence; loopy sum-product passing spreads it, so that a number that is
a card or phone in one place is found where its layout escapes the patterns. Potentials are estimated piecewise from
counts over the whole corpus; kinds that a token's characters rule out are barred.

Like tokens meet in hubs, one per normal form and one per last seven digits. Of each a token hears as much as in a
chain of like tokens, two of the others, each through a skip potential: first those inside pattern matches, which speak
with the mean of their weights, then the rest, with theirs; hubs of digits speak for the other forms only. A token's
weights are all it knows but for one of the messages heard, which in a chain would come from the listener. So neither
distance nor number of the repeats weakens a match, and two like tokens hear each other as along an edge. Passing ends,
document by document, when the messages stand still.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import map_arrow, materialise, slices, table

KINDS = ("email", "ip", "card", "phone")
#: What the patterns of the base spans are.
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"[0-9]++(?:\.[0-9]++)*+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"

#: Shapes are told apart by so many hash values; the strength of a pattern match; damping of the passing.
SHAPES, EVIDENCE, DAMPING = 4096, 20.0, 0.4
#: Pairs of equal labels that count as seen beforehand: neighbours may differ, like tokens hardly do.
CHAIN_PRIOR, SKIP_PRIOR = 2.0, 3000.0
#: Least log weight that a shape gives to a label, and that of a label that a token's characters rule out.
LEAST_UNARY, BARRED = -5.0, -60.0
#: Messages that change by less stand still; a document whose messages never do is left after so many rounds.
STILL, MOST_ROUNDS = 1e-6, 1000
#: Documents whose messages are passed at once.
ROWS = 2000
#: A token is taken if its label other than "none" has this probability.
TAKE_AT = 0.6
LABELS = len(KINDS) + 1
_STRIP = ",.;:!?\"'$%&#*|<>[]{}=~`^"
_MARK = re.compile(r"[0-9@]+")
_RUN = re.compile(r"[0-9]+|[^\W\d_]+")
#: Runs of a token up to which its shape is told; beyond, it is one of long mixed tokens. A part of a spaced number has
#: no longer run of digits than SHORT_RUN, and the number no more digits than MOST_DIGITS.
MOST_RUNS, SHORT_RUN, MOST_DIGITS = 8, 6, 19
_PART = re.compile(r"[0-9+().\-/]+")


def _luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        if i % 2:
            n = 2 * n - 9 if n > 4 else 2 * n
        total += n
    return total % 10 == 0


def _emails(text: str) -> list[tuple[int, int]]:
    """Matches of local@domain, found from the @ signs: the local part is all that may stand before one."""
    out, free, at = [], 0, text.find("@")
    while at >= 0:
        width = 64
        while True:
            before = text[max(free, at - width) : at]
            local = len(before) - len(before.rstrip(_LOCAL))
            if local < len(before) or at - width <= free:
                break
            width *= 8
        if local and (m := _DOMAIN.match(text, at + 1)):
            free = m.end()
            out.append((at - local, free))
        at = text.find("@", at + 1)
    return out


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the pattern matches, by kind, then start. Failing matches are dropped, not retried."""
    out = [("email", a, b) for a, b in _emails(text)]
    if not any(c in text for c in "0123456789"):
        return out
    for m in _DOTTED.finditer(text):
        # leftmost matches take four parts of a dotted row each, from its start; each row is passed over once
        parts = m[0].split(".") if m.end() - m.start() >= 7 else []
        at = m.start()
        for k in range(0, len(parts) - 3, 4):
            four = parts[k : k + 4]
            end = at + sum(map(len, four)) + 3
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in four):
                out.append(("ip", at, end))
            at = end + 1
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13:
            digits = m[0].replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and _luhn(digits):
                out.append(("card", m.start(), m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= sum(c in "0123456789" for c in m[0]) <= 15:
                out.append(("phone", m.start(), m.end()))
    return out


def _bucket(n: int) -> str:
    return str(n) if n <= 4 else "5-6" if n <= 6 else "7-8" if n <= 8 else "9-12" if n <= 12 else "13-19" if n <= 19 else "20+"


def _shape(word: str, digits: str) -> str:
    """Kinds and sizes of the runs of a token; for long numbers also whether their check digit holds."""
    check = "" if not 13 <= len(digits) <= 19 else "+" if _luhn(digits) else "-"
    if sum(1 for _ in _RUN.finditer(word)) > MOST_RUNS:
        return check + ("mixed" if any(c.isalpha() for c in word) else "long")
    return check + _RUN.sub(lambda m: _bucket(len(m[0])) + "d" if m[0][0].isdigit() and m[0].isascii() else "a", word)


def _kinds(word: str, digits: str) -> int:
    """Bits of the labels that a token can have. A number, whatever separates its digits, has no letters among them."""
    if "@" in word:
        return 0b00011
    letters = "".join(c for c in word if c.isalnum()).strip("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")
    if letters != digits:
        return 0b00001
    ip = sum(1 for _ in re.finditer("[0-9]+", word)) >= 4 and len(digits) <= 12
    return 1 | ip << 2 | (13 <= len(digits) <= 19) << 3 | (7 <= len(digits) <= 15) << 4


def _spaced(text: str, found: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """(start, end, label) of tokens, parts of one number put together: neighbours with one space between them that lie
    in one pattern match, or have only short runs of digits, seven digits in all at least and MOST_DIGITS at most."""
    out: list[tuple[int, int, int]] = []
    i = 0
    while i < len(found):
        j, digits = i + 1, sum(c.isdigit() for c in text[found[i][0] : found[i][1]])
        if _part(text, found[i]):
            while j < len(found) and found[j][2] == found[i][2] and found[j][0] - found[j - 1][1] <= 3 and _between(text, found[j - 1][1], found[j][0]) and _part(text, found[j]):
                digits += sum(c.isdigit() for c in text[found[j][0] : found[j][1]])
                j += 1
        if j > i + 1 and 7 <= digits <= MOST_DIGITS:
            out.append((found[i][0], found[j - 1][1], found[i][2]))
        else:
            out += found[i:j]
        i = j
    return out


def _part(text: str, token: tuple[int, int, int]) -> bool:
    word = text[token[0] : token[1]]
    return bool(_PART.fullmatch(word)) and (token[2] > 0 or max(map(len, re.findall("[0-9]+", word))) <= SHORT_RUN)


def _between(text: str, a: int, b: int) -> bool:
    return text[a:b].strip("()+") == " "


def tokens_of(text: str, spans: list[tuple[str, int, int]]) -> list[tuple[int, int, int, int, str, str, int, int]]:
    """Tokens with a digit or @: (start, end, label, shape, normal form, last seven digits, follows, kinds).

    Outer punctuation is not part of a token. label is that of the pattern match it lies in, 0 if none; follows is 1 if
    only white space and punctuation separate it from the token before; kinds are the labels it can have.
    """
    found: list[tuple[int, int, int]] = []
    done = 0
    marks = sorted((a, b, KINDS.index(k) + 1) for k, a, b in spans)
    k = 0
    for m in _MARK.finditer(text):
        if m.start() < done:
            continue
        start, end = m.start(), m.end()
        while start > done and not text[start - 1].isspace():
            start -= 1
        n = len(text)
        while end < n and not text[end].isspace():
            end += 1
        word, done = text[start:end], end
        left = len(word) - len(word.lstrip(_STRIP))
        word = word.strip(_STRIP)
        if not word:
            continue
        start += left
        end = start + len(word)
        while k < len(marks) and marks[k][1] <= start:
            k += 1
        label = next((l for a, b, l in marks[k : k + 4] if a < end and start < b), 0)
        found.append((start, end, label))
    out: list[tuple] = []
    for start, end, label in _spaced(text, found):
        word = text[start:end]
        digits = "".join(c for c in word if "0" <= c <= "9")
        follows = int(bool(out) and not text[out[-1][1] : start].strip(_STRIP + " \t\r\n\v\f"))
        shape = zlib.crc32(_shape(word, digits).encode()) % SHAPES
        out.append((start, end, label, shape, word.lower(), digits[-7:] if len(digits) >= 7 else "", follows, _kinds(word, digits) | 1 << label))
    return out


def _edges(tokens: list[tuple]) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """Chain edges between neighbours, and pairs of each token and the last one like it, from which skip potentials are
    counted: as many as tokens."""
    chain = [(i - 1, i) for i, t in enumerate(tokens) if t[6]]
    skip, seen = [], {}
    for i, t in enumerate(tokens):
        for key in {("form", t[4]), ("digits", t[5])} if t[5] else {("form", t[4])}:
            if key in seen and (i - 1, i) != (seen[key], i) or key in seen and not t[6]:
                skip.append((seen[key], i))
            seen[key] = i
    return chain, sorted(set(skip))


def _hubs(tokens: list[tuple]) -> list[tuple[int, int]]:
    """Numbers of the hubs of each token, of its form and of its last seven digits, from 0; without seven digits, the
    second is again for the form. Tokens of one form have the same digits."""
    numbers: dict[tuple[str, str], int] = {}
    return [tuple(numbers.setdefault(k, len(numbers)) for k in (("form", t[4]), ("digits", t[5]) if t[5] else ("form", t[4]))) for t in tokens]


def _through(x: np.ndarray, pair: np.ndarray) -> np.ndarray:
    """Messages of log weights x through pair potentials; the largest value of each is 0."""
    out = x[:, :, None] + pair
    top = out.max(1)
    new = np.log(np.exp(out - top[:, None, :]).sum(1)) + top
    return new - new.max(1, keepdims=True)


def _sums(at: np.ndarray, x: np.ndarray, n: int) -> np.ndarray:
    return np.stack([np.bincount(at, x[:, l], n) for l in range(x.shape[1])], 1)


class Field:
    """Potentials of the field, from counts of (shape, label) and of label pairs along chain and skip edges."""

    def __init__(self, shapes: np.ndarray, chain: np.ndarray, skip: np.ndarray) -> None:
        prior = np.full(LABELS, 0.02 / (LABELS - 1))
        prior[0] = 0.98
        # a token that no pattern matches is not known to be none of the kinds, however many of its shape there are
        self.unary = np.maximum(np.log((shapes + prior) / (shapes.sum(1, keepdims=True) + 1)), LEAST_UNARY)
        # a mention outside of pattern matches may still be personal data: that tells nothing about like tokens
        skip = skip * (np.eye(LABELS) + np.outer(np.arange(LABELS) > 0, np.arange(LABELS) > 0) > 0)
        counts = chain + chain.T + CHAIN_PRIOR * np.eye(LABELS)
        apart = counts.sum(1)[:, None] * counts.sum(0)[None, :] / counts.sum()
        self.chain = np.clip(np.log((counts + 1) / (apart + 1)), -3, 3)
        counts = skip + skip.T + SKIP_PRIOR * np.eye(LABELS) + 1
        self.skip = np.log(counts / np.sqrt(counts.sum(1)[:, None] * counts.sum(0)[None, :]))

    def beliefs(self, shapes: np.ndarray, labels: np.ndarray, kinds: np.ndarray, chain: np.ndarray, hub: np.ndarray, document: np.ndarray) -> np.ndarray:
        """Label probabilities of each token by loopy sum-product; kinds are the labels that each can have, chain has
        pairs of token numbers, hub the numbers of each token's two hubs, document that of its document. What a document
        gets does not depend on the others."""
        unary = self.unary[shapes] + np.where(kinds[:, None] >> np.arange(LABELS) & 1, 0.0, BARRED)
        known = labels > 0
        unary[known, labels[known]] += EVIDENCE
        final = np.zeros_like(unary)
        at = np.arange(len(unary))
        tail, head = np.concatenate([chain[:, 0], chain[:, 1]]), np.concatenate([chain[:, 1], chain[:, 0]])
        along = np.repeat([True, False], len(chain))
        back = (np.arange(len(tail)) + len(chain)) % max(len(tail), 1)
        message, told = np.zeros((len(tail), LABELS)), np.zeros_like(unary)
        for _ in range(MOST_ROUNDS):
            n = len(at)
            own = unary + _sums(head, message, n)
            new_told = DAMPING * told + (1 - DAMPING) * self._told(own, told, known, hub)
            out = (own + told)[tail] - message[back]
            new = np.where(along[:, None], _through(out, self.chain), _through(out, self.chain.T))
            new = DAMPING * message + (1 - DAMPING) * new
            moved = np.abs(new_told - told).max(1) >= STILL
            moved[head[np.abs(new - message).max(1) >= STILL]] = True
            message, told = new, new_told
            busy = np.zeros(int(document.max(initial=-1)) + 1, bool)
            busy[document[moved]] = True
            stay = busy[document]
            if not stay.all():  # documents whose messages stand still leave
                final[at[~stay]] = (unary + told + _sums(head, message, n))[~stay]
                number, kept = np.cumsum(stay) - 1, stay[head]
                place = np.cumsum(kept) - 1
                tail, head, along, back, message = number[tail[kept]], number[head[kept]], along[kept], place[back[kept]], message[kept]
                at, unary, known, told, document = at[stay], unary[stay], known[stay], told[stay], document[stay]
                hub = np.unique(hub[stay], return_inverse=True)[1].reshape(-1, 2)
            if not len(at):
                break
        final[at] = unary + told + _sums(head, message, len(at))
        final -= final.max(1, keepdims=True)
        p = np.exp(final)
        return p / p.sum(1, keepdims=True)

    def _told(self, own: np.ndarray, told: np.ndarray, known: np.ndarray, hub: np.ndarray) -> np.ndarray:
        """What each token hears from its hubs, told being what it heard last."""
        hubs = int(hub.max(initial=-1)) + 1
        like = [np.bincount(h, minlength=hubs)[h] for h in hub.T]
        times = np.minimum(like[0] - 1, 2) + np.minimum(like[1] - like[0], 2)
        own = own + told * (1 - 1 / np.maximum(times, 1))[:, None]
        own -= own.max(1, keepdims=True)
        heard, room = np.zeros_like(own), np.full((len(own), 2), 2)
        for kind in (known, ~known):
            x = own[kind]
            counts = [np.bincount(h[kind], minlength=hubs)[h] for h in hub.T]
            totals = [_sums(h[kind], x, hubs)[h] for h in hub.T]
            others = ((counts[0] - kind, totals[0] - np.where(kind[:, None], own, 0)), (counts[1] - counts[0], totals[1] - totals[0]))
            for k, (count, total) in enumerate(others):
                times = np.minimum(count, room[:, k])
                room[:, k] -= times
                some = np.flatnonzero(times)
                heard[some] += times[some, None] * _through(total[some] / count[some, None], self.skip)
        return heard


def _network(documents: list[list[tuple]]) -> tuple[np.ndarray, ...]:
    """(shapes, labels, kinds, chain, like pairs, hubs, documents) of all tokens."""
    shapes, labels, kinds, chain, skip, hub, at, hubs = [], [], [], [], [], [], 0, 0
    for tokens in documents:
        c, s = _edges(tokens)
        chain += [(at + a, at + b) for a, b in c]
        skip += [(at + a, at + b) for a, b in s]
        shapes += [t[3] for t in tokens]
        labels += [t[2] for t in tokens]
        kinds += [t[7] for t in tokens]
        hub += [(hubs + f, hubs + d) for f, d in _hubs(tokens)]
        at += len(tokens)
        hubs += 2 * len(tokens)
    pairs = [np.array(x, np.int64).reshape(-1, 2) for x in (chain, skip)]
    document = np.repeat(np.arange(len(documents)), [len(t) for t in documents])
    return *(np.array(x, np.int64) for x in (shapes, labels, kinds)), *pairs, np.array(hub, np.int64).reshape(-1, 2), document


def spans_of(documents: list[tuple[list, list]], field: Field) -> list[list[tuple[str, int, int]]]:
    """All spans of each (base spans, tokens): the base ones, and those that the field adds outside of them."""
    shapes, labels, kinds, chain, _, hub, document = _network([t for _, t in documents])
    p = field.beliefs(shapes, labels, kinds, chain, hub, document) if len(shapes) else np.zeros((0, LABELS))
    best = p[:, 1:].argmax(1) + 1 if len(p) else np.zeros(0, np.int64)
    sure = p[np.arange(len(p)), best] >= TAKE_AT if len(p) else np.zeros(0, bool)
    out, at = [], 0
    for base, tokens in documents:
        added: list[list] = []
        for i, t in enumerate(tokens):
            if sure[at + i] and not t[2]:
                kind = KINDS[best[at + i] - 1]
                if kind == "phone" and added and t[6] and added[-1][3] == i - 1 and added[-1][0] == kind:
                    added[-1][2:] = [t[1], i]
                else:
                    added.append([kind, t[0], t[1], i])
        every = base + [(k, a, b) for k, a, b, _ in added]
        out.append(sorted(every, key=lambda x: (KINDS.index(x[0]), x[1], x[2])))
        at += len(tokens)
    return out


def _count(documents: list[list[tuple]]) -> list[tuple[int, int]]:
    """Counts by number: shapes first, then chain pairs, then skip pairs."""
    shapes, labels, _, chain, skip, _, _ = _network(documents)
    keys = [shapes * LABELS + labels]
    for k, pairs in enumerate((chain, skip)):
        keys.append(SHAPES * LABELS + k * LABELS**2 + labels[pairs[:, 0]] * LABELS + labels[pairs[:, 1]])
    values, counts = np.unique(np.concatenate(keys), return_counts=True)
    return list(zip(values.tolist(), counts.tolist()))


_TOKENS = "array<struct<start:long,end:long,label:int,shape:int,form:string,digits:string,follows:int,kinds:int>>"
_SPANS = "array<struct<kind:string,start:long,end:long>>"


def analysed(docs: DataFrame) -> DataFrame:
    """(doc_id, base, tokens) of each document: pattern matches and tokens of the whole text; a null text is empty."""
    span, token = ("kind", "start", "end"), ("start", "end", "label", "shape", "form", "digits", "follows", "kinds")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                texts = part.column(1).to_pylist()
                base = [base_spans(t) for t in texts]
                yield pa.RecordBatch.from_pylist(
                    [
                        {"doc_id": i, "base": [dict(zip(span, x)) for x in b], "tokens": [dict(zip(token, x)) for x in tokens_of(t, b)]}
                        for i, t, b in zip(part.column(0).to_pylist(), texts, base)
                    ],
                    schema=arrow,
                )

    schema = f"doc_id long, base {_SPANS}, tokens {_TOKENS}"
    spans = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.int32(), pa.int32()]
    arrow = pa.schema([("doc_id", pa.int64()), ("base", spans), ("tokens", pa.list_(pa.struct(list(zip(token, kinds)))))])
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return map_arrow(docs, work, schema)


def _rows(x: pd.DataFrame) -> tuple[list, list]:
    base = [[(s["kind"], s["start"], s["end"]) for s in b] for b in x["base"]]
    return base, [[tuple(t.values()) for t in ts] for ts in x["tokens"]]


def _few(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Batches of ROWS documents at most: what a document gets does not depend on the others."""
    for x in batches:
        for at in range(0, len(x), ROWS):
            yield x.iloc[at : at + ROWS]


def fit(found: DataFrame) -> Field:
    """The field of a corpus, from analysed(): at most SHAPES * LABELS + 2 * LABELS**2 counts reach the driver."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in _few(batches):
            yield pd.DataFrame(_count(_rows(x)[1]), columns=["what", "n"])

    with_tokens = found.where(F.size("tokens") > 0)
    counts = np.zeros(SHAPES * LABELS + 2 * LABELS**2)
    for what, n in with_tokens.mapInPandas(work, "what int, n long").groupBy("what").agg(F.sum("n")).collect():
        counts[what] = n
    a, b = SHAPES * LABELS, LABELS**2
    return Field(counts[:a].reshape(SHAPES, LABELS), counts[a : a + b].reshape(LABELS, LABELS), counts[a + b :].reshape(LABELS, LABELS))


def find(docs: DataFrame) -> DataFrame:
    """(doc_id, base, spans) of each document: pattern matches, and all spans with what the field adds.

    Null and empty texts have no spans; rows with equal ids are found one by one; an empty table gives no rows; other
    columns are not looked at. A text is read whole by one task, in time that follows its length.
    """
    found = materialise(analysed(docs), "pii_tokens")
    field = fit(found)

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in _few(batches):
            base, tokens = _rows(x)
            spans = spans_of(list(zip(base, tokens)), field)
            yield pd.DataFrame({"doc_id": x["doc_id"], "base": x["base"], "spans": [[dict(zip(("kind", "start", "end"), s)) for s in d] for d in spans]})

    return found.mapInPandas(work, f"doc_id long, base {_SPANS}, spans {_SPANS}")


def masked(docs: DataFrame) -> DataFrame:
    """docs with each span of the text replaced by its kind in angle brackets, and n_chars, where there is such a
    column, set to the new length. Where spans overlap, one mark stands for all; null texts stay null. Texts are read
    twice and not moved: first for the counts that make the field, then to replace."""
    field = fit(materialise(analysed(docs), "pii_tokens"))
    columns = docs.columns
    where = columns.index("text")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                texts = part.column(where).to_pylist()
                known = [(b := base_spans(t or ""), tokens_of(t or "", b)) for t in texts]
                out = []
                for text, spans in zip(texts, spans_of(known, field)):
                    if spans:
                        pieces, at = [], 0
                        for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
                            if a >= at:
                                pieces += [text[at:a], f"<{kind.upper()}>"]
                            at = max(at, b)
                        text = "".join([*pieces, text[at:]])
                    out.append(text)
                arrays = [pa.array(out, part.column(where).type) if i == where else part.column(i) for i in range(len(columns))]
                yield pa.RecordBatch.from_arrays(arrays, schema=part.schema)

    out = docs.mapInArrow(work, docs.schema)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in columns else out


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find(table(spark, sf_dir, "documents"))

    def joined(column: str):
        return F.array_join(F.transform(column, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def number(kind: str):
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select("doc_id", *[number(k) for k in KINDS], F.sha2(joined("base").cast("binary"), 256).alias("base_sha256"), joined("spans").alias("spans"))
