"""Personal data: patterns of four kinds, and a linear-chain conditional random field for more.

Base spans come from patterns (leftmost, non-overlapping for each kind, checked after the match).  The
random field labels white-space tokens O, email, ip, card, phone or secret from word-shape features:
the token's own shape, its length, the shape of the next token and the words before it.  It is
trained here, by gradient steps on the exact likelihood, on a small labelled table of everyday lines
written for it, and decoded by Viterbi over batches of sequences in numpy.  A token that has no digit,
no ``@`` and under ``LONG`` characters is always O (in training as well), so a chain falls apart at such
tokens and only the runs between them are decoded: the result is that of decoding the whole text.  So a
secret of letters only is found if it is that long; shorter passwords of letters are not looked for.
Decoded spans that touch no base span are added.

Null and empty texts have no spans; texts and tokens of any length are read whole; repeated rows and null
ids are scanned each; an empty table gives no rows.  ``find_pii`` ignores extra columns, ``redact`` keeps them.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import pieces, record

LABELS = ["O", "email", "ip", "card", "phone", "secret"]
BASE = LABELS[1:5]
_EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")

Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    """Whether the digits pass Luhn's test."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def _emails(text: str) -> Iterator[Span]:
    """As ``finditer`` gives them, found from each ``@`` so that long runs of letters cost nothing."""
    at, free = text.find("@"), 0
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        if start < at and (m := _EMAIL.match(text, start)):
            yield ("email", m.start(), m.end())
            free = m.end()
        at = text.find("@", max(at + 1, free))


_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def base_spans(text: str) -> list[Span]:
    """Spans of the patterns, by kind as listed, then start; in code points, end exclusive."""
    found: list[Span] = []
    if "@" in text:
        found += _emails(text)
    if _DIGIT.search(text):
        found += [("ip", m.start(), m.end()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
        for m in _CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and luhn(digits):
                found.append(("card", m.start(), m.end()))
        if "+" in text:
            found += [("phone", m.start(), m.end()) for m in _PHONE.finditer(text) if 9 <= sum(c.isdecimal() for c in m[0]) <= 15]
    return found


# the random field


LONG = 20
_SHAPES = [(re.compile(r"[0-9]"), "9"), (re.compile(r"[A-Z]"), "A"), (re.compile(r"[^\W\d_A-Z]"), "a"), (re.compile(r"(.)\1{2,}", re.DOTALL), r"\1\1")]


def shape(token: str) -> str:
    """Letters as a or A, digits as 9; runs of one class are shortened to two signs."""
    for pattern, sign in _SHAPES:
        token = pattern.sub(sign, token)
    return token


def _kind(token: str, size: int) -> str:
    """The shape, or of a long one that it is long and how."""
    found = shape(token)
    return found if len(found) <= size else f"long {len(set(found))}"


_HEX = re.compile(r"\W*[0-9a-fA-F]{16,}\W*")
_MIXED = re.compile(r"\W*(?=\w*[0-9])(?=\w*[A-Za-z])[\w/+=-]{16,}\W*")


def features(tokens: list[str], i: int) -> list[str]:
    token = tokens[i]
    digits = _NOT_DIGIT.sub("", token)
    before = tokens[i - 1] if i else "^"
    earlier = tokens[i - 2] if i > 1 else "^"
    after = tokens[i + 1] if i + 1 < len(tokens) else "$"
    word = lambda x: re.sub(r"\W", "", x.lower()) or x[:3]
    return [
        "bias",
        "shape=" + _kind(token, 24),
        f"digits={min(len(digits), 20)}",
        f"length={min(len(token), 64) // 4}",
        f"dots={min(token.count('.'), 4)}",
        f"at={'@' in token}",
        f"luhn={13 <= len(digits) <= 19 and luhn(digits)}",
        f"hex={bool(_HEX.fullmatch(token))}",
        f"mixed={bool(_MIXED.fullmatch(token))}",
        f"quoted={token[:1] in _QUOTES and len(token) > LONG}",
        f"turns={min(len(_TURN.findall(token)), 12) // 2}",
        f"joined={len(token) > LONG and bool(_JOINED.fullmatch(token))}",
        "before=" + word(before),
        "earlier=" + word(earlier),
        "next=" + _kind(after, 12),
        "last=" + _kind(before, 12),
    ]


_NOT_DIGIT = re.compile(r"[^0-9]+")
_QUOTES = "\"'`"
#: changes of case or class inside a word, which prose has few of
_TURN = re.compile(r"[a-z](?=[A-Z0-9])|[0-9](?=[A-Za-z])")
_JOINED = re.compile(r"\w+\W{1,2}(?=\w*[0-9A-Z])[\w/+=-]{16,}\W*")


def can_be(token: str) -> bool:
    """Whether a token may have a label other than O."""
    return len(token) >= LONG or "@" in token or bool(_DIGIT.search(token))


#: the labelled table: values in braces get the label of their name; ``{n}`` and the like stay O
TABLE = [
    "please write to {email} for details", "mail: {email}, thanks", "{email}", "contact {email} or call {phone}", "my address is {email} and yours",
    "the words around {email} mean nothing", "she sent it to {email} last week", "our server {ip} was down", "from {ip} to {ip}", "blocked {ip} again",
    "the machine at {ip} did not answer", "the host {ip}, port {n}", "login from {ip}.", "pay with {card} today", "card number {card} expires {date}",
    "he read out {card} slowly", "visa {card} , amount {n}", "{card}", "charge {card} please", "call me at {phone} today", "phone: {phone}", "tel {phone} fax {phone}",
    "the number {phone} is mine", "office | {phone} | home", "call {plainphone} now", "phone {plainphone}", "api key: {secret}", "password = {secret}", "password: {secret}",
    '{name}="{secret}"', '{name} = "{secret}"', "{name} = '{secret}'", "{name}: {secret}", 'export {name}="{secret}"', "set {name} to {secret} and restart", "{name} {secret} expires soon",
    "authorization: bearer {secret}", "bearer {secret}", '{name} = "{secret}";', '{name} = "{secret}"!!', "use {secret} to sign in", "his {name} was {secret} until may",
    "version {n}.{n} of the text", "in {year} there were {n} cases", "{date} was a day", "chapter {n}, page {n}", "the price is {n}.{n} euro",
    "commit {hexid} fixes it", "sha {hexid}", "merged {hexid} into main", "see figure {n} and table {n}", "the licence, version 3.", "edition 2.0.",
    "order {n} has {n} items", "at {n}:{n} on {date}", "it is {n}% more", "isbn {isbn}", "the id {n} and the id {n}", "a@b is not one", "@name said so", "item{n} of list{n}",
    "we counted {longid} grains", "number {longid} of the list", "{longid}", "card {longid} is no card",
    "a list of {n} , {n} , {n}", "no data here at all", "room {n}b, level {n}", "{year}-{year}", "x{n} + y{n} = {n}", "release {n}.{n}.{n} is out",
    "an {longword} is a {longword} too", "{longword}", "the {longword}, said they", "{longword}: a {longword}.", "his {name} was {longword} enough", "see {address} for more", "open {address}", "{noise}", "a line of {noise} here",
    'he called it "{longword}" again', "{longword}-{longword}", "{name} is a word",
]
#: names that secrets are given in code and letters
NAMES = ["api_key", "apikey", "password", "passwd", "secret", "client_secret", "access_key", "private_key", "auth", "credential", "session_key", "pin", "token", "pass"]


def _value(kind: str, draw: np.random.Generator) -> str:
    digits = lambda n: "".join(map(str, draw.integers(0, 10, n)))
    pick = lambda options: options[int(draw.integers(len(options)))]
    letters = lambda n: "".join(pick("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
    if kind == "email":
        return pick([f"{letters(5)}.{digits(2)}@mail{digits(1)}.example.com", f"{letters(6)}@{letters(5)}.org", f"{letters(3)}_{letters(4)}+{letters(2)}@{letters(7)}.co.uk", f"{letters(4)}{digits(2)}@{letters(6)}.de"])
    if kind == "ip":
        return ".".join(str(draw.integers(1, 256)) for _ in range(4))
    if kind == "card":
        x = digits(15)
        x += next(str(k) for k in range(10) if luhn(x + str(k)))
        return pick([x, "-".join(x[i : i + 4] for i in range(0, 16, 4))])
    if kind == "longid":
        x = digits(int(pick([13, 16, 16, 18])))
        return x if not luhn(x) else x[:-1] + str((int(x[-1]) + 1) % 10)
    if kind == "phone":
        return pick([f"+1 ({digits(3)}) {digits(3)}-{digits(4)}", f"+{digits(2)} {digits(3)} {digits(7)}", f"+{digits(2)}-{digits(3)}-{digits(6)}"])
    if kind == "plainphone":
        return pick([f"({digits(3)}) {digits(3)}-{digits(4)}", f"{digits(3)}-{digits(3)}-{digits(4)}"])
    if kind in ("secret", "hexid"):
        big, small = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
        alphabet = "0123456789abcdef" if kind == "hexid" else pick(["0123456789abcdef", "0123456789ABCDEF", big + small + "0123456789", big + small + "0123456789+/", big + small, small + "0123456789"])
        return "".join(pick(alphabet) for _ in range(int(pick([7, 12, 40, 40]) if kind == "hexid" else pick([20, 24, 32, 40, 64]))))
    if kind == "name":
        return pick(NAMES + [x.upper() for x in NAMES])
    if kind == "longword":
        return "".join(pick(["inter", "nation", "al", "isation", "ment", "ver", "sicher", "ungs", "gesell", "schaft", "anti", "con", "stitu", "tion", "elle", "ment", "des", "arrollo", "respon", "sabil", "idad"]) for _ in range(int(draw.integers(4, 7))))
    if kind == "address":
        return f"https://www.{letters(7)}.org/{letters(5)}/{letters(8)}"
    if kind == "noise":
        return pick("=-_*#x") * int(draw.integers(16, 70))
    if kind == "year":
        return str(draw.integers(1900, 2030))
    if kind == "date":
        return f"{draw.integers(1990, 2030)}-{draw.integers(10, 13)}-{draw.integers(10, 29)}"
    if kind == "isbn":
        return f"978-{digits(1)}-{digits(3)}-{digits(5)}-{digits(1)}"
    return str(draw.integers(0, 5000))


def labelled_table(copies: int = 12, seed: int = 7) -> list[tuple[list[str], list[int]]]:
    """Tokens and labels of each row of the table, filled with drawn values."""
    draw = np.random.default_rng(seed)
    rows = []
    for line in TABLE * copies:
        tokens: list[str] = []
        labels: list[int] = []
        text, spans = "", []
        for i, part in enumerate(re.split(r"\{(\w+)\}", line)):
            if i % 2:
                value, kind = _value(part, draw), {"plainphone": "phone"}.get(part, part)
                if kind in LABELS:
                    spans.append((len(text), len(text) + len(value), LABELS.index(kind)))
                text += value
            else:
                text += part
        for m in re.finditer(r"\S+", text):
            tokens.append(m[0])
            labels.append(next((k for s, e, k in spans if m.start() < e and m.end() > s), 0))
        rows.append((tokens, labels))
    return rows


class Field:
    """Weights of the random field: a row of label scores for each feature, and of label changes."""

    def __init__(self, names: dict[str, int], emit: np.ndarray, move: np.ndarray):
        self.names, self.emit, self.move = names, emit, move

    def scores(self, sequences: list[list[str]], places: list[tuple[int, int]]) -> list[np.ndarray]:
        """Scores of the tokens in [a, b) of each sequence."""
        return [np.array([self.emit[[k for f in features(tokens, i) if (k := self.names.get(f)) is not None]].sum(0) for i in range(a, b)]) for tokens, (a, b) in zip(sequences, places, strict=True)]


def train(rows: list[tuple[list[str], list[int]]] | None = None, steps: int = 120, rate: float = 0.15, decay: float = 1e-3) -> Field:
    """Fit by Adam on the mean log-likelihood, all sequences at once (padded; padding is always O)."""
    rows = rows or labelled_table()
    n, t, m = len(rows), max(len(x) for x, _ in rows), len(LABELS)
    names: dict[str, int] = {}
    at, feature = [], []
    gold = np.zeros((n, t), np.int64)
    mask = np.zeros((n, t, m))
    mask[:, :, 1:] = -1e9
    for r, (tokens, labels) in enumerate(rows):
        gold[r, : len(labels)] = labels
        for i in range(len(tokens)):
            if can_be(tokens[i]):
                mask[r, i] = 0
            for f in features(tokens, i):
                at.append(r * t + i)
                feature.append(names.setdefault(f, len(names)))
    at, feature = np.array(at), np.array(feature)
    weights = [np.zeros((len(names), m)), np.zeros((m, m))]
    first, second = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]
    right = np.zeros((n * t, m))
    right[np.arange(n * t), gold.ravel()] = 1
    right_moves = np.zeros((m, m))
    np.add.at(right_moves, (gold[:, :-1].ravel(), gold[:, 1:].ravel()), 1)
    total = lambda x, axis: (top := x.max(axis, keepdims=True)).squeeze(axis) + np.log(np.exp(x - top).sum(axis))
    for step in range(1, steps + 1):
        emit, move = weights
        score = np.zeros((n * t, m))
        np.add.at(score, at, emit[feature])
        score = score.reshape(n, t, m) + mask
        ahead, back = np.zeros((n, t, m)), np.zeros((n, t, m))
        ahead[:, 0] = score[:, 0]
        for i in range(1, t):
            ahead[:, i] = score[:, i] + total(ahead[:, i - 1, :, None] + move, 1)
        for i in range(t - 2, -1, -1):
            back[:, i] = total(move + (score[:, i + 1] + back[:, i + 1])[:, None, :], 2)
        all_paths = total(ahead[:, -1], 1)[:, None, None]
        marginal = np.exp(ahead + back - all_paths).reshape(n * t, m)
        pairs = np.exp(ahead[:, :-1, :, None] + move + (score + back)[:, 1:, None, :] - all_paths[..., None]).sum((0, 1))
        down = np.zeros_like(emit)
        np.add.at(down, feature, (marginal - right)[at])
        for k, slope in enumerate((down / n + decay * emit, (pairs - right_moves) / n + decay * move)):
            first[k] = 0.9 * first[k] + 0.1 * slope
            second[k] = 0.999 * second[k] + 0.001 * slope**2
            weights[k] = weights[k] - rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    return Field(names, *weights)


def viterbi(scores: list[np.ndarray], move: np.ndarray) -> list[np.ndarray]:
    """Best labels of sequences that stand between O tokens; those of one length are decoded together."""
    found: list[np.ndarray] = [np.zeros(0, np.int64)] * len(scores)
    sizes = np.array([len(s) for s in scores])
    for size in np.unique(sizes):
        rows = np.flatnonzero(sizes == size)
        block = np.stack([scores[r] for r in rows])
        best = move[0] + block[:, 0]
        came = []
        for i in range(1, size):
            ways = best[:, :, None] + move
            came.append(ways.argmax(1))
            best = ways.max(1) + block[:, i]
        path = [(best + move[:, 0]).argmax(1)]
        for step in reversed(came):
            path.append(np.take_along_axis(step, path[-1][:, None], 1)[:, 0])
        for r, labels in zip(rows, np.stack(path[::-1], 1), strict=True):
            found[r] = labels
    return found


_EDGE = re.compile(r"[A-Za-z0-9@+(]")


def field_spans(texts: list[str], field: Field) -> list[list[Span]]:
    """Spans that the random field finds in each text, by start."""
    sequences, places, where = [], [], []
    for n, text in enumerate(texts):
        if not _CANDIDATE.search(text):
            continue
        for tokens, run in _runs(text):
            sequences.append([x for x, _ in tokens])
            places.append(run)
            where.append((n, tokens))
    found: list[list[Span]] = [[] for _ in texts]
    for (n, tokens), (a, b), labels in zip(where, places, viterbi(field.scores(sequences, places), field.move), strict=True):
        i = 0
        while i < b - a:
            j = i
            while j < b - a and labels[j] == labels[i]:
                j += 1
            if labels[i]:
                start, end = tokens[a + i][1], tokens[a + j - 1][1] + len(tokens[a + j - 1][0])
                text = texts[n]
                while start < end and not _EDGE.match(text[start]):
                    start += 1
                while end > start and not text[end - 1].isalnum():
                    end -= 1
                if end > start:
                    found[n].append((LABELS[labels[i]], start, end))
            i = j
    return found


_TOKEN = re.compile(r"[^\x20\x09-\x0D]+")
_CANDIDATE = re.compile(r"[0-9@]|[^\x20\x09-\x0D]{20}")


def _runs(text: str) -> Iterator[tuple[list[tuple[str, int]], tuple[int, int]]]:
    """Runs of tokens that may have a label, with two tokens before and one behind."""
    space = " \t\n\x0b\x0c\r"
    m = _CANDIDATE.search(text)
    while m:
        start = m.start()
        while start and text[start - 1] not in space:
            start -= 1
        run: list[tuple[str, int]] = []
        follow = None
        for t in _TOKEN.finditer(text, start):
            if not can_be(t[0]):
                follow = (t[0], t.start())
                break
            run.append((t[0], t.start()))
        lead: list[tuple[str, int]] = []
        end = start
        while len(lead) < 2:
            while end and text[end - 1] in space:
                end -= 1
            begin = end
            while begin and text[begin - 1] not in space:
                begin -= 1
            if begin == end:
                break
            lead.insert(0, (text[begin:end], begin))
            end = begin
        yield lead + run + ([follow] if follow else []), (len(lead), len(lead) + len(run))
        m = _CANDIDATE.search(text, run[-1][1] + len(run[-1][0]))


def find_spans(texts: list[str | None], field: Field) -> tuple[list[list[Span]], list[list[Span]]]:
    """Base spans, and all spans (those and the field's), by kind as listed, then start."""
    texts = [x or "" for x in texts]
    base = [base_spans(x) for x in texts]
    every = []
    for own, more in zip(base, field_spans(texts, field), strict=True):
        more = [x for x in more if not any(x[1] < e and s < x[2] for _, s, e in own)] if more else more
        every.append(sorted(own + more, key=lambda x: (LABELS.index(x[0]), x[1])))
    return base, every


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


RESULT = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_spans long"


def find_pii(docs: DataFrame, field: Field | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Spans of every row, as text ``kind:start:end``."""
    field = field or train()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text"):
                base, every = find_spans(part.column("text").to_pylist(), field)
                columns = {f"n_{k}": [sum(x[0] == k for x in own) for own in base] for k in BASE}
                yield record(RESULT, columns | {"doc_id": part.column("doc_id"), "base_sha256": [hashlib.sha256(joined(x).encode()).hexdigest() for x in base], "spans": [joined(x) for x in every], "n_spans": [len(x) for x in every]})

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(scan, RESULT)


def redacted(text: str, spans: list[Span]) -> str:
    """The text with each span replaced by its kind in angle brackets; overlapping ones by the first's."""
    out, at = [], 0
    for kind, start, end in sorted(spans, key=lambda x: (x[1], -x[2])):
        if start >= at:
            out += [text[at:start], f"<{kind.upper()}>"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, field: Field | None = None, text: str = "text", n_chars: str = "n_chars") -> DataFrame:
    """The rows with personal data replaced; null texts stay null, ``n_chars`` (if there) is counted anew."""
    field = field or train()
    place = docs.columns.index(text)
    count = docs.columns.index(n_chars) if n_chars in docs.columns else None

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, text):
                texts = part.column(place).to_pylist()
                _, every = find_spans(texts, field)
                clean = [None if x is None else redacted(x, s) if s else x for x, s in zip(texts, every, strict=True)]
                columns = part.columns
                columns[place] = pa.array(clean, part.schema.field(place).type)
                if count is not None:
                    sizes = [old if not s else len(new) for old, new, s in zip(part.column(count).to_pylist(), clean, every, strict=True)]
                    columns[count] = pa.array(sizes, part.schema.field(count).type)
                yield pa.RecordBatch.from_arrays(columns, schema=part.schema)

    return docs.mapInArrow(scan, docs.schema)
