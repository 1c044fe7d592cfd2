"""Personal data in texts: fixed patterns, and a conditional random field for spellings that the patterns miss.

The field is a linear chain over tokens with word-shape features (kind of token, number of digits, key words, punctuation, white
space before it) of a token and its two neighbours on either side. It is trained by maximum likelihood from a small labelled
table, and decoded by Viterbi in numpy, the stretches of a batch of texts together. It looks at the stretches around digits, ``@`` and
every ``at`` in brackets or before a spelled-out domain: REACH characters on either side and on to the next white space; elsewhere there is nothing that it is trained to label. A span that it proposes must pass its kind's
check (Luhn for cards, four parts up to 255 for addresses, 9 to 15 digits for phones), and must not touch a span of the patterns or a
match of its own kind that failed its check; so the base spans stay as they are.

A null text counts as empty. Empty texts have no spans. Repeated rows give equal results; positions are code points, ends exclusive.
Texts are read whole, in time and memory that grow in proportion. Extra columns of any name are kept or ignored as asked for by ``keep``; one that is named
like a result is replaced by it.
"""

from __future__ import annotations

import bisect
import functools
import hashlib
import itertools
import random
import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .sequences import viterbi
from .textbatch import map_rows

KINDS = ("email", "ip", "card", "phone")
LABELS = ("O", *(f"{p}-{k}" for k in KINDS for p in "BI"))

# Fixed patterns of the base. Looking behind a run of digits or trying no shorter run changes no match: it only saves retries.
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGITS = re.compile(r"[^0-9]+")


def luhn(digits: str) -> bool:
    odd = sum(int(d) for d in digits[-1::-2])
    return (odd + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])) % 10 == 0


def valid(kind: str, text: str) -> bool:
    if kind == "ip":
        parts = re.findall("[0-9]+", text)
        return len(parts) == 4 and all(len(q) <= 3 and int(q or 0) <= 255 for q in (p.lstrip("0") for p in parts))
    digits = _DIGITS.sub("", text)
    if kind == "card":
        return 12 <= len(digits) <= 19 and luhn(digits)
    if kind == "phone":
        return 9 <= len(digits) <= 15
    return True


def base_spans(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Spans (start, kind's index, end) of the patterns in order, and of the matches that failed their check."""
    good, bad = [], []
    at, free = text.find("@"), 0
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            good.append((start, 0, m.end()))
            free = m.end()
        at = text.find("@", max(at + 1, free))
    for i, pattern in ((1, _IP), (2, _CARD), (3, _PHONE)):
        for m in pattern.finditer(text):
            (good if valid(KINDS[i], m[0]) else bad).append((m.start(), i, m.end()))
    good.sort()
    return good, bad


# --- the field -------------------------------------------------------------------------------------------------------------------

TOKEN = re.compile(r"[0-9]+|[^\W\d_]+|[^\w\s]|[^\S\n]*\n|\d|_")
#: Spelled-out domains: names joined by signs without space or by words; a plain ``at`` needs a word among them, since prose has ``at noon. Then``, and ``point`` a domain's end, since it has ``at this point in``.
_NAME, _WORD = r"\w[\w-]*+", r"\W{0,3}\b(?:dot|punkt|point)\b\W{0,3}"
_PLAIN = r"\W{0,3}\b(?:dot|punkt|point(?=\W{1,3}(?:\w+\W{1,3}point\W{1,3}){0,8}(?:com|org|net|edu|gov|info|eu|fr|ch|ca|lu)\b))\b\W{0,3}"
_MORE = rf"(?:(?:[\[(]?\.[\])]?|{_WORD}){_NAME})"
_BRACKETED = r"[\[(]\s?at\s?[\])]"
TRIGGER = re.compile(rf"(?:@|{_BRACKETED})\s?{_NAME}{_MORE}+|\bat\b\W{{0,3}}{_NAME}(?:\.{_NAME})*{_PLAIN}{_NAME}{_MORE}*|[0-9@]|{_BRACKETED}", re.I)
#: An address within a longer span that the field proposes. Without brackets only ``dot`` joins names here: ``at this point in`` is prose.
WITHIN = re.compile(rf"(?<![\w.+%-])(?:[\w.+%-]++\s?{_BRACKETED}\s?{_NAME}{_MORE}+|[\w.+%-]++\W{{1,3}}\bat\b\W{{1,3}}{_NAME}(?:\W{{1,3}}dot\W{{1,3}}{_NAME})+)", re.I)
_SPACE = re.compile(r"\s")
REACH = 40
#: Tokens that are decoded at once. A longer stretch is cut between plain words.
MOST_TOKENS = 100_000
#: Words that stand before personal data, and words that spell signs out.
KEYWORDS = {w: i for i, ws in enumerate(("phone tel telephone call mobile cell fax dial text sms telefon telefono teléfono téléphone", "mail email e contact write correo courriel", "card visa mastercard amex credit debit tarjeta carte karte", "ip host server address adresse", "at", "dot punkt point", "isbn order version id no invoice ref token serial account date page")) for w in ws.split()}
_SIGNS = "@.-+()[]_:/,=\"'#$%"
_DIGIT_SHAPES = 9
_WORD_SHAPES = 3
N_SHAPES = _DIGIT_SHAPES + _WORD_SHAPES + 7 + len(_SIGNS) + 2
N_SYMBOLS = 2 * N_SHAPES + 1  # the last: no token there
OFFSETS = (-2, -1, 0, 1, 2)


@functools.lru_cache(1 << 16)
def _shape(token: str) -> int:
    c = token[0]
    if "0" <= c <= "9":
        n = len(token)
        return (0 if n == 1 else 1 if n == 2 else 2 if n == 3 and token <= "255" else 3 if n == 3 else 4 if n == 4 else 5 if n < 9 else 6 if n < 12 else 7 if n < 20 and luhn(token) else 8)
    if c.isalpha():
        key = KEYWORDS.get(token.lower())
        return _DIGIT_SHAPES + (_WORD_SHAPES + key if key is not None else 0 if len(token) == 1 else 1 if len(token) < 4 else 2)
    sign = _SIGNS.find(c)
    return _DIGIT_SHAPES + _WORD_SHAPES + 7 + (sign if sign >= 0 else len(_SIGNS) + ("\n" in token))


def tokens(text: str, start: int, end: int) -> tuple[list[int], list[int], list[int]]:
    """Starts, ends and symbols of the tokens of text[start:end]."""
    a, b, s, last = [], [], [], start
    for m in TOKEN.finditer(text, start, end):
        a.append(m.start())
        b.append(m.end())
        s.append(2 * _shape(m[0]) + (m.start() > last or m.start() == start))
        last = m.end()
    return a, b, s


def _windows(symbols: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """For each token the symbols at OFFSETS, of its own sequence only."""
    n = len(symbols)
    at = np.arange(n)
    first, last = np.repeat(starts, ends - starts), np.repeat(ends, ends - starts)
    out = np.full((n, len(OFFSETS)), N_SYMBOLS - 1, np.int64)
    for k, o in enumerate(OFFSETS):
        ok = (at + o >= first) & (at + o < last)
        out[ok, k] = symbols[at[ok] + o]
    return out


#: The labelled table. {kind:...} marks personal data; D stands for any digit, O for a number up to 255, L for sixteen digits that pass Luhn, N for sixteen that fail.
TABLE = """call {phone:(DDD) DDD-DDDD} today
her number is {phone:DDD-DDD-DDDD} at home
tel {phone:DDD.DDD.DDDD} or write
phone: {phone:0DD DDDDDDDD} please
dial {phone:+DD DDD DDDDDDD} now
tel {phone:(0DD) DD DD DD DD} or
telefon {phone:0DD DD DD DD DD} in
ring {phone:0D DD DD DD DD} today
fax {phone:+D (DDD) DDD-DDDD} and wait
ring {phone:+DDDDDDDDDDDD} soon
the {phone:+D (DDD) DDD-DDDD} of the
mobile {phone:0DDDD/DDDDDDD} in the
{phone:(DDD) DDD-DDDD} is mine
write to {email:john.smith@mail.example.com} today
the {email:anna_b@example.org} is
mail {email:josé.ruiz@correo.example.es} or
contact {email:mike [at] example [dot] com} for
send it to {email:sara (at) mail (dot) example (dot) org} and
{email:lee(at)example.com} wrote
reach {email:info at example dot com} for
email {email:kim [at] example.net}
was {email:x.DD@mailD.example.com} of
the host {ip:O.O.O.O} is down
from {ip:O.O.O.O} to
ip {ip:O.O.O.O}: refused
server {ip:O[.]O[.]O[.]O} answered
paid with {card:L} on
card {card:L} was
visa {card:L} expired
the {card:L} of
the N of
order N was sent
serial N and
in N the
token = "DaDDfDbcDDDDeDDDaDbD" of
token = "dDDDDDbDcDDDDDeDfD" and the
on DDDD-DD-DD we met
at DD:DD on DD.DD.DDDD he
DD/DD/DDDD was a day
version D.D.D of the
version D.DD.D is out
page DDD of DDDD
it cost $DDD.DD or D,DDD,DDD in all
ISBN DDD-D-DDD-DDDDD-D was read
DDDD people and DD dogs
it was the best of times and the worst
de la que en el y los
the cat sat at home and the dog at work
look at dot one
twitter @name said so
a @ b is no mail
D + D = DD
chapter DD , section D.D
the years DDDD-DDDD were
DDD DDD DDD are numbers
section D.D.D.D.D of it
DD, DD, DD and DD
id DDDDDDDDDD in the
number DDD-DD-DDDD was his
the DDD-DD-DDDD of
account DDDDDDDDDDDDDDDDDDDDDD closed"""


def labelled(copies: int = 6, seed: int = 7) -> list[tuple[str, list[tuple[int, int, int]]]]:
    """The table with digits filled in: texts and their spans (start, kind's index, end)."""
    rng = random.Random(seed)

    def sixteen(ok: bool) -> str:
        while luhn(s := str(rng.randrange(10**15, 10**16))) != ok:
            pass
        return s

    fill = {"D": lambda: str(rng.randrange(10)), "O": lambda: str(rng.randrange(256)), "L": lambda: sixteen(True), "N": lambda: sixteen(False)}
    rows = []
    for line in TABLE.splitlines():
        for _ in range(copies):
            text, spans = "", []
            for part in re.split(r"(\{\w+:[^}]*\})", line):
                kind, _, body = part[1:-1].partition(":") if part.startswith("{") else ("", "", part)
                body = re.sub(r"[DOLN](?![A-Za-z]*[A-Z])" if not kind else "[DOLN]", lambda m: fill[m[0]](), body) if not re.match(r"ISBN", body) else "ISBN" + re.sub("D", lambda m: fill["D"](), body[4:])
                if kind:
                    spans.append((len(text), KINDS.index(kind), len(text) + len(body)))
                text += body
            rows.append((text, spans))
    return rows


#: What a proposed span must look like as a whole, by kind.
SHAPES = (
    re.compile(r"(?i)[\w.+%-]+\W{0,3}(?:@|\bat\b)\W{0,3}\w[\w-]*(?:\W{0,3}(?:\.|\bdot\b|\bpunkt\b|\bpoint\b)\W{0,3}\w[\w-]*)+"),
    re.compile(r"[0-9]{1,3}(?:[\[(\s]{0,2}\.[\])\s]{0,2}[0-9]{1,3}){3}"),
    re.compile(r"[0-9](?:[\s.\-/]{0,2}[0-9])+"),
    re.compile(r"(?![0-9]{3}-[0-9]{2}-[0-9]{4}\Z)(?=.*[^0-9])[+(0-9][0-9\s().\-/]*[0-9]"),
)


class Field:
    """weights: (offsets, symbols, labels); trans: (labels, labels); first: labels."""

    def __init__(self):
        k = len(LABELS)
        self.weights, self.trans, self.first = np.zeros((len(OFFSETS), N_SYMBOLS, k)), np.zeros((k, k)), np.zeros(k)

    def scores(self, windows: np.ndarray) -> np.ndarray:
        return sum(self.weights[i, windows[:, i]] for i in range(len(OFFSETS)))


@functools.lru_cache(1)
def train(rounds: int = 100, rate: float = 0.15, decay: float = 1e-4) -> Field:
    """Maximum likelihood with a penalty on squares, by Adam on the whole table; forward and backward sums over all rows at once."""
    rows = labelled()
    syms, gold = [], []
    for text, spans in rows:
        a, _, s = tokens(text, 0, len(text))
        y = np.zeros(len(a), np.int64)
        for start, kind, end in spans:
            inside = [i for i, x in enumerate(a) if start <= x < end]
            y[inside] = 2 + 2 * kind
            y[inside[0]] = 1 + 2 * kind
        syms.append(np.array(s))
        gold.append(y)
    size = np.array([len(s) for s in syms])
    ends = np.cumsum(size)
    starts = ends - size
    windows, y = _windows(np.concatenate(syms), starts, ends), np.concatenate(gold)
    n, t, k = len(rows), size.max(), len(LABELS)
    place = (np.repeat(np.arange(n), size), np.concatenate([np.arange(s) for s in size]))
    live = np.arange(t)[None] < size[:, None]
    f = Field()
    params = [f.weights, f.trans, f.first]
    seen = [np.zeros_like(p) for p in params]
    seen_x = np.zeros((len(y), k))
    seen_x[np.arange(len(y)), y] = 1
    follow = np.delete(np.arange(len(y)), starts)
    np.add.at(seen[1], (y[follow - 1], y[follow]), 1)
    np.add.at(seen[2], y[starts], 1)
    m1, m2 = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]

    def lse(x: np.ndarray, axis: int) -> np.ndarray:
        top = x.max(axis, keepdims=True)
        return (top + np.log(np.exp(x - top).sum(axis, keepdims=True))).squeeze(axis)

    for step in range(1, rounds + 1):
        e = np.zeros((n, t, k))
        e[place] = f.scores(windows)
        alpha, beta = np.zeros((n, t, k)), np.zeros((n, t, k))
        alpha[:, 0] = e[:, 0] + f.first
        for i in range(1, t):
            alpha[:, i] = np.where(live[:, i, None], lse(alpha[:, i - 1, :, None] + f.trans[None], 1) + e[:, i], alpha[:, i - 1])
        total = lse(alpha[:, -1], 1)
        for i in range(t - 2, -1, -1):
            beta[:, i] = np.where(live[:, i + 1, None], lse(f.trans[None] + (e[:, i + 1] + beta[:, i + 1])[:, None, :], 2), 0)
        p = np.exp(alpha + beta - total[:, None, None]) * live[:, :, None]
        pair = np.zeros((k, k))
        for i in range(1, t):
            on = live[:, i]
            pair += np.exp(alpha[on, i - 1, :, None] + f.trans[None] + (e[on, i] + beta[on, i])[:, None, :] - total[on, None, None]).sum(0)
        off = p[place] - seen_x
        grads = [np.zeros_like(f.weights), pair - seen[1], p[:, 0].sum(0) - seen[2]]
        for i in range(len(OFFSETS)):
            np.add.at(grads[0][i], windows[:, i], off)
        for q, g, a, b in zip(params, grads, m1, m2, strict=True):
            g = g / n + decay * q
            a += 0.1 * (g - a)
            b += 0.01 * (g * g - b)
            q -= rate * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.99**step)) + 1e-8)
    return f


def stretches(text: str) -> list[tuple[int, int]]:
    """Parts of the text around triggers, widened to white space on both sides, however far: no word is cut. What a stretch covers isn't looked at again, so all of them take one pass."""
    out: list[tuple[int, int]] = []
    for m in TRIGGER.finditer(text):
        last = out[-1][1] if out else 0
        if m.end() + REACH <= last:
            continue
        a, b = max(0, m.start() - REACH), min(len(text), m.end() + REACH)
        while a > last and not text[a - 1].isspace() and not text[a].isspace():
            a -= 1
        if b < len(text) and not text[b - 1].isspace():
            b = max(b, found.start() if (found := _SPACE.search(text, b)) else len(text))
        if out and a <= last:
            out[-1] = (out[-1][0], max(b, last))
        else:
            out.append((a, b))
    return out


_PLAIN_WORD = 2 * (_DIGIT_SHAPES + 2)


def _pieces(symbols: list[int], most: int) -> list[int]:
    """The ends of pieces of at most so many tokens, cut after a plain word where there is one in the last half."""
    ends, at = [], 0
    while len(symbols) - at > most:
        end = at + most
        while end > at + most // 2 and not all(s - s % 2 == _PLAIN_WORD for s in symbols[end - 2 : end + 1]):
            end -= 1
        at = end if end > at + most // 2 else at + most
        ends.append(at)
    return [*ends, len(symbols)]


def added_spans(texts: list[str], base: list, field: Field) -> list[list[tuple[int, int, int]]]:
    """What the field adds to the base spans (a pair of good and bad lists for each text)."""
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    held: list[tuple[int, list[int], list[int], list[int]]] = []
    size = 0
    for i, text in enumerate(texts):
        for x, y in stretches(text) if text else ():
            p, q, r = tokens(text, x, y)
            at = 0
            for end in _pieces(r, MOST_TOKENS) if r else ():
                if size + end - at > MOST_TOKENS and held:
                    _decode(texts, base, field, held, out)
                    held, size = [], 0
                held.append((i, p[at:end], q[at:end], r[at:end]))
                size += end - at
                at = end
    if held:
        _decode(texts, base, field, held, out)
    return out


_LOCAL_END, _DOMAIN_END = re.compile(r"[\w.+%-]"), re.compile(r"[\w-]")


def whole_address(text: str, start: int, kind: int, end: int) -> tuple[int, int, int]:
    """A span of an address, widened to where the run of its characters begins and its last name ends: no address is left in part."""
    while start > 0 and _LOCAL_END.match(text[start - 1]):
        start -= 1
    while end < len(text) and _DOMAIN_END.match(text[end]):
        end += 1
    return start, kind, end


def _decode(texts: list[str], base: list, field: Field, held: list, out: list[list[tuple[int, int, int]]]) -> None:
    """Labels the held stretches and puts the spans that pass into out."""
    a, b, s = ([x for h in held for x in h[k]] for k in (1, 2, 3))
    sizes = [len(h[1]) for h in held]
    ends = np.cumsum(sizes)
    starts = ends - sizes
    labels = viterbi(field.scores(_windows(np.array(s), starts, ends)), starts, field.trans, field.first)
    owner = np.repeat([h[0] for h in held], sizes)
    begin = np.zeros(len(s), bool)
    begin[starts] = True
    kind = (labels + 1) // 2
    fresh = (labels > 0) & (begin | (labels % 2 == 1) | (np.concatenate([[0], kind[:-1]]) != kind))
    proposed: list[tuple[int, tuple[int, int, int]]] = []
    widened: dict[int, int] = {}
    for i in np.flatnonzero(fresh).tolist():
        j = i + 1
        while j < len(s) and not begin[j] and labels[j] == 2 * kind[i]:
            j += 1
        doc, k = int(owner[i]), int(kind[i]) - 1
        span = (a[i], k, b[j - 1])
        if k == 0:
            # A run that was widened over is done: all of its addresses were proposed then.
            if span[0] < widened.get(doc, 0):
                continue
            span = whole_address(texts[doc], *span)
            widened[doc] = span[2]
        if k == 0 and not SHAPES[k].fullmatch(texts[doc], span[0], span[2]):
            proposed += [(doc, (m.start(), k, m.end())) for m in WITHIN.finditer(texts[doc], span[0], span[2])]
        else:
            proposed.append((doc, span))
    taken: dict[int, list] = {}
    for doc, span in proposed:
        k = span[1]
        if doc not in taken:
            good, bad = base[doc]
            taken[doc] = [_Cover(good), *(_Cover([m for m in bad if m[1] == i]) for i in range(len(KINDS)))]
        if taken[doc][0].meets(span) or taken[doc][1 + k].meets(span) or not valid(KINDS[k], texts[doc][span[0] : span[2]]):
            continue
        text = texts[doc]
        if not SHAPES[k].fullmatch(text, span[0], span[2]) or text[max(0, span[0] - 1) : span[0]].isalnum() or text[span[2] : span[2] + 1].isalnum():
            continue
        if not out[doc] or out[doc][-1][2] <= span[0]:
            out[doc].append(span)


class _Cover:
    """Spans by start, with the furthest end so far, to tell in logarithmic time whether another span touches one of them."""

    def __init__(self, spans: list[tuple[int, int, int]]):
        spans = sorted(spans)
        self.starts = [s[0] for s in spans]
        self.ends = list(itertools.accumulate((s[2] for s in spans), max))

    def meets(self, span: tuple[int, int, int]) -> bool:
        i = bisect.bisect_left(self.starts, span[2])
        return i > 0 and self.ends[i - 1] > span[0]


def find(texts: list[str | None], field: Field) -> list[tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]]:
    """For each text the base spans and all spans, by start and kind."""
    texts = [t or "" for t in texts]
    base = [base_spans(t) if t and re.search("[0-9@]", t) else ([], []) for t in texts]
    more = added_spans(texts, base, field)
    return [(good, sorted(good + extra)) for (good, _), extra in zip(base, more, strict=True)]


def redacted(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with every span, or run of overlapping ones, replaced by the first one's kind in angle brackets."""
    out, last = [], 0
    for start, kind, end in spans:
        if start >= last:
            out += [text[last:start], f"<{KINDS[kind].upper()}>"]
        last = max(last, end)
    return "".join([*out, text[last:]])


def _apply(docs: DataFrame, keep: list[str], text: str, schema: str, row) -> DataFrame:
    """keep's columns, then what row(text, base, all) gives by column."""
    field, width = train(), len(schema.split(", "))

    def rows(texts: list[str | None]) -> list:
        found = [row(t, base, spans) for t, (base, spans) in zip(texts, find(texts, field), strict=True)]
        return list(zip(*found, strict=True)) if found else [[]] * width

    return map_rows(docs, keep, text, schema, rows)


def _joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def find_pii(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """keep's columns and n_email, n_ip, n_card, n_phone (of the base), base_sha256 and spans (all), for every row."""

    def row(t, base, spans):
        n = [0] * len(KINDS)
        for _, k, _ in base:
            n[k] += 1
        return (*n, hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(spans))

    return _apply(docs, keep, text, "n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string", row)


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with every span of the text replaced by its kind; a null text stays null. Other columns are kept as they are."""
    keep = [c for c in docs.columns if c.lower() != text.lower()]
    out = _apply(docs, keep, text, f"`{text}` string", lambda t, _, spans: (t if t is None or not spans else redacted(t, spans),))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])


def op10_pii(spark, sf_dir: str) -> DataFrame:
    return find_pii(spark.read.parquet(f"{sf_dir}/documents.parquet"), ["doc_id"])
