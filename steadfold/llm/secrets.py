"""Secret scans: fixed patterns, and a linear-chain conditional random field that tags tokens as begin, inside or outside.

The patterns' spans always stay. The field learns from them, on a bounded sample, with other names and drawn secrets in
their place, and with links, paths, identifiers and other ordinary items in theirs, what a secret and its surroundings look
like, and adds spans that no pattern describes. A text decodes window by window, around whatever has a shape that keys
have (digits, capitals after small letters, long runs of letters) and around every word that names secrets. In a window
every token of letters, digits or joining marks may be part of a secret: the learned weights say which is.
"""

from __future__ import annotations

import random
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import release, stash

#: The base patterns, in the order in which spans of one start are listed, with the group that is the
#: secret itself and its least length. Letters of an assignment's name count in either case.
KINDS = {
    "assign": (re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII), 2, 6),
    "access": (re.compile(r"AKIA[A-Z0-9]+"), 0, 20),
    "hex": (re.compile(r"[0-9a-f]+"), 0, 24),
}
#: Names that an assignment has one of.
NAMES = ("password", "passwd", "secret", "token", "apikey", "api_key")
LONG_HEX = re.compile(r"[0-9a-f]{24,}")
LEARNED = "learned"
ORDER = {k: i for i, k in enumerate([*KINDS, LEARNED])}

TOKEN = re.compile(r"[A-Za-z0-9]+|[^A-Za-z0-9\s]")
#: Fixed value: what windows lie around. Java reads it alike.
LIKELY = re.compile(r"[0-9][A-Za-z0-9]*|[a-z][A-Z][A-Za-z0-9]*|[A-Za-z]{20,}|(?i:passw|passphrase|passcode|pwd|secret|token|credential|bearer|login|auth|(?<![a-z])key(?![a-z]))[A-Za-z_]{0,12}")
BLANK = re.compile(r"\s")
OUTSIDE, BEGIN, INSIDE = 0, 1, 2
#: Characters before and after such a place that its window takes in.
BEFORE, AFTER = 48, 24


def base_spans(text: str) -> list[tuple[str, int, int, int]]:
    """(kind, start, end, start of the secret itself), in order; leftmost and non-overlapping within a kind."""
    found = []
    if ":" in text or "=" in text:
        folded = text.lower()
        if any(n in folded for n in NAMES):
            pattern, group, least = KINDS["assign"]
            found += [("assign", m.start(), m.end(), m.start(group)) for m in pattern.finditer(text) if m.end(group) - m.start(group) >= least]
    if "AKIA" in text:
        pattern, _, least = KINDS["access"]
        found += [("access", m.start(), m.end(), m.start()) for m in pattern.finditer(text) if m.end() - m.start() >= least]
    # A match is a whole run, so the runs of 24 or more are the matches that do not fail.
    found += [("hex", m.start(), m.end(), m.start()) for m in LONG_HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[1], ORDER[s[0]]))


@dataclass
class Window:
    """Tokens around likely places; features of each: indices into the model's weights."""

    spans: list[tuple[int, int]]
    features: list[list[int]]
    may: np.ndarray


class Codes(dict):
    """The number below 2 ** bits of a feature (kind, value), remembered up to a bound."""

    MOST = 300_000

    def __init__(self, bits: int):
        super().__init__()
        self.bits = bits

    def __missing__(self, feature: tuple) -> int:
        if len(self) >= self.MOST:
            self.clear()
        got = xxhash.xxh3_64_intdigest("=".join(map(str, feature))) & ((1 << self.bits) - 1)
        if len(str(feature[-1])) <= 64:
            self[feature] = got
        return got


@lru_cache(200_000)
def _shape(token: str) -> str:
    if not token[0].isalnum():
        return token
    kinds = ("a" if any(c.islower() for c in token) else "") + ("A" if any(c.isupper() for c in token) else "") + ("0" if any(c.isdigit() for c in token) else "")
    if "0" in kinds and "A" not in kinds and all(c in "0123456789abcdef" for c in token):
        kinds += "h"
    return f"{kinds}{min(len(token).bit_length(), 7)}"


@lru_cache(200_000)
def _inside(token: str) -> tuple[tuple, ...]:
    """Features of a token by itself: its shape and length, and how random it looks or which word it is."""
    found = [("s", _shape(token)), ("l", min(len(token), 40))]
    if len(token) <= 12:
        found.append(("w", token.lower()))
    if len(token) >= 6:
        kind = ["0" if c.isdigit() else "A" if c.isupper() else "a" for c in token]
        switches, vowels = sum(x != y for x, y in zip(kind, kind[1:])), sum(c in "aeiouAEIOU" for c in token)
        found += [("distinct", len(set(token)) * 8 // len(token)), ("switches", min(switches, 9)), ("vowels", vowels * 8 // len(token))]
    return tuple(found)


#: Fixed value: words that name secrets.
NAMED = re.compile(r"(?i)passw|passphrase|passcode|pwd|secret|token|credential|bearer|login|auth|^key$")


#: What a run without white space may be as a whole, the first that holds.
CHUNKS = {name: re.compile(pattern) for name, pattern in {
    "link": r".{0,4}?(?:[a-z]+://|www\.)", "mail": r".{0,64}?@[A-Za-z0-9-]+\.[a-z]", "doi": r".{0,8}?10\.\d{4,}/",
    "uuid": r".{0,8}?[0-9A-Fa-f]{8}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{12}", "path": r"[\"'(]?(?:[A-Za-z]:\\|[.~]{0,2}/)[\w.-]", "file": r"[\w/.-]{1,99}/[\w.-]+\.[a-z]{1,4}\b",
    "number": r"[^A-Za-z]+$", "version": r"[\"'(]?v?\d+\.\d+(?:\.\d+|-)", "time": r"\d{4}-\d\d-\d\dT", "bytes": r"(?:[0-9A-Fa-f]{2}:){3}",
}.items()}


def chunk_kind(chunk: str) -> str:
    """What a run without white space is as a whole; an identifier has letters and joining marks alone."""
    head = chunk[:128]
    for name, pattern in CHUNKS.items():
        if pattern.match(head):
            return name
    return "name" if re.fullmatch(r"[A-Za-z_.()]+[^\w\s]*", head) else "other"


def file_features(text: str, source: str | None) -> list[str]:
    """Of the text as a whole: its length, how much of it is code-like marks, and where it comes from."""
    marks = sum(text.count(c) for c in "{};=<>")
    return [f"size{len(text).bit_length()}", f"marks{min(int(200 * marks / (len(text) + 1)), 5)}", f"source={source}"]


def _ranges(text: str) -> list[list[int]]:
    """Stretches of whole words around likely places, in order and apart. Each character is looked at a few times at most,
    however long a word is."""
    out: list[list[int]] = []
    for m in LIKELY.finditer(text):
        low, high, done = max(0, m.start() - BEFORE), min(len(text), m.end() + AFTER), out[-1][1] if out else -1
        if high <= done:
            continue
        if (end := BLANK.search(text, high)) is None:
            high = len(text)
        else:
            high = end.start()
        while low > max(done, 0) and not text[low - 1].isspace():
            low -= 1
        if low <= done:
            out[-1][1] = high
        else:
            out.append([low, high])
    return out


def windows(text: str, source: str | None, codes: Codes) -> Iterator[Window]:
    ranges = _ranges(text)
    of_file = file_features(text, source) if ranges else []
    for low, high in ranges:
        spans = [(m.start(), m.end()) for m in TOKEN.finditer(text, low, high)]
        tokens = [text[a:b] for a, b in spans]
        shapes = ["#", *map(_shape, tokens), "#"]
        near = ["#", "#", "#", *(t[:12].lower() for t in tokens), "#"]
        chunk, kinds, ended = "", [], -1
        for a, b in spans:
            if a >= ended:  # spans come in order: the run that this one is in begins anew
                begins, ended = a, m.start() if (m := BLANK.search(text, b, a + 512)) else min(len(text), a + 512)
                while begins > low and a - begins < 64 and not text[begins - 1].isspace():
                    begins -= 1
                chunk = chunk_kind(text[begins:ended])
            kinds.append(chunk)
        since, last = [], 9  # tokens since one that names secrets
        for token in tokens:
            since.append(last)
            last = 0 if NAMED.search(token[:40]) else min(last + 1, 9)
        glued = [False, *(a[1] == b[0] for a, b in zip(spans, spans[1:])), False]
        features = []
        for i, token in enumerate(tokens):
            shape = shapes[i + 1]
            own = [*_inside(token), ("p", near[i + 2]), ("pp", near[i + 1]), ("ppp", near[i]), ("n", near[i + 4]), ("ps", shapes[i]), ("ns", shapes[i + 2])]
            own += [("g", glued[i], glued[i + 1]), ("sp", shape, near[i + 2]), ("c", kinds[i]), ("cs", kinds[i], shape), ("d", since[i], shape), ("dk", since[i], kinds[i], shapes[i]), *(("f", shape, x) for x in of_file)]
            features.append([codes[x] for x in own])
        yield Window(spans, features, np.array([t[0].isalnum() or t in "+/_=-." for t in tokens]))


@dataclass
class Field:
    """A linear-chain conditional random field over the tags outside, begin and inside."""

    bits: int
    weights: np.ndarray = field(default=None)
    steps: np.ndarray = field(default=None)
    codes: Codes = field(default=None, repr=False)

    #: Inside follows begin or inside alone.
    BARRED = np.array([[0, 0, 1], [0, 0, 0], [0, 0, 0]], bool)

    def __post_init__(self):
        if self.weights is None:
            self.weights, self.steps = np.zeros((1 << self.bits, 3)), np.zeros((3, 3))
        if self.codes is None:
            self.codes = Codes(self.bits)

    def scores(self, window: Window) -> np.ndarray:
        s = np.array([self.weights[f].sum(axis=0) for f in window.features])
        s[~window.may, 1:] = -1e9
        s[0, INSIDE] = -1e9
        return s

    def viterbi(self, window: Window) -> list[int]:
        s, t = self.scores(window), np.where(self.BARRED, -1e9, self.steps)
        best, back = s[0], []
        for row in s[1:]:
            ways = best[:, None] + t
            back.append(ways.argmax(axis=0))
            best = ways.max(axis=0) + row
        tags = [int(best.argmax())]
        for b in reversed(back):
            tags.append(int(b[tags[-1]]))
        return tags[::-1]


def batch_gradient(weights: np.ndarray, steps: np.ndarray, flat: np.ndarray, counts: np.ndarray, lengths: np.ndarray, may: np.ndarray, tags: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """(minus the log likelihood, its gradient by weights, and by steps) of many windows at once: forward and backward sums
    go through the places of all windows in step, the long ones first. flat: features of all tokens in a row; counts: how
    many each token has; lengths: tokens of each window."""
    order = np.argsort(-lengths, kind="stable")
    n, longest = len(lengths), int(lengths.max(initial=0))
    owner = np.repeat(np.arange(len(counts)), counts)
    emit = np.stack([np.bincount(owner, weights[flat, k], minlength=len(counts)) for k in range(3)], axis=1)
    emit[~may, 1:] = -1e9
    starts = (np.cumsum(lengths) - lengths)[order]
    emit[starts, INSIDE] = -1e9
    size = lengths[order]
    live = np.searchsorted(-size, -np.arange(longest) - 0.5)  # windows with a token at each place
    t = np.where(Field.BARRED, -1e9, steps)
    total = lambda x, axis: (m := x.max(axis=axis)) + np.log(np.exp(x - np.expand_dims(m, axis)).sum(axis=axis))
    ahead, behind = np.zeros_like(emit), np.zeros_like(emit)
    ahead[starts] = emit[starts]
    for i in range(1, longest):
        at = starts[: live[i]] + i
        ahead[at] = emit[at] + total(ahead[at - 1][:, :, None] + t, 1)
    for i in range(longest - 2, -1, -1):
        at = starts[: live[i + 1]] + i
        behind[at] = total(t + (emit[at + 1] + behind[at + 1])[:, None, :], 2)
    z = np.empty(n)
    z[order] = total(ahead[starts + size - 1], 1)
    each = np.repeat(z, lengths)
    of_tags, first = np.exp(ahead + behind - each[:, None]), np.zeros(len(counts), bool)
    first[starts] = True
    at = np.nonzero(~first)[0]
    pairs = np.exp(ahead[at - 1][:, :, None] + t + (emit[at] + behind[at])[:, None, :] - each[at][:, None, None])
    by_steps = pairs.sum(axis=0)
    np.add.at(by_steps, (tags[at - 1], tags[at]), -1)
    gold = emit[np.arange(len(tags)), tags].sum() + t[tags[at - 1], tags[at]].sum()
    of_tags[np.arange(len(tags)), tags] -= 1
    by_weights = np.stack([np.bincount(flat, of_tags[owner, k], minlength=len(weights)) for k in range(3)], axis=1)
    return float(z.sum() - gold), by_weights, np.where(Field.BARRED, 0.0, by_steps)


def minimised(value: Callable[[np.ndarray], tuple[float, np.ndarray]], x: np.ndarray, rounds: int, memory: int = 8) -> np.ndarray:
    """A minimum of value (with its gradient) by quasi-Newton steps of limited memory, halved until they lead down."""
    now, gradient = value(x)
    pairs: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(rounds):
        step, seen = -gradient, []
        for s, g in reversed(pairs):
            seen.append((s @ step) / (s @ g))
            step = step - seen[-1] * g
        step = step * ((pairs[-1][0] @ pairs[-1][1]) / (pairs[-1][1] @ pairs[-1][1]) if pairs else 1 / max(1.0, float(np.linalg.norm(gradient))))
        for (s, g), a in zip(pairs, reversed(seen)):
            step = step + (a - (g @ step) / (s @ g)) * s
        size, slope = 1.0, float(gradient @ step)
        for _ in range(12):
            new, new_gradient = value(x + size * step)
            if new <= now + 1e-4 * size * slope:
                break
            size /= 2
        else:
            return x
        if (s := size * step) @ (g := new_gradient - gradient) > 1e-12:
            pairs = [*pairs[-memory + 1 :], (s, g)]
        small = now - new < 1e-6 * max(abs(now), 1.0)
        x, now, gradient = x + size * step, new, new_gradient
        if small:
            return x
    return x


def tags_of(window: Window, secrets: list[tuple[int, int]]) -> list[int]:
    """Tags of the window's tokens, given the places of secrets."""
    tags: list[int] = []
    for (a, b), may in zip(window.spans, window.may):
        here = next(((x, y) for x, y in secrets if a < y and b > x), None) if may else None
        tags.append(OUTSIDE if here is None else INSIDE if tags and tags[-1] and previous == here else BEGIN)
        previous = here
    return tags


#: Other names of secrets, and what may stand between a name and a secret. The base patterns know few names
#: and two marks; that these are followed by secrets, too, is what the field learns from them.
OTHER_NAMES = "pwd pass passphrase password secret_key client_secret auth credential credentials access_key private_key signing_key api-key apikey bearer key token secret login AWS_SECRET_ACCESS_KEY DB_PASS".split()
JOINTS = (" ", " ", " ", " ", "_", " is ", " was ", " = ", "=", ": ", ":", " -> ", " => ", ' "', "='", ': "', " (", " '")
ALPHABETS = ("0123456789abcdef", "abcdefghijklmnopqrstuvwxyz0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789")
#: Words that stand before ordinary items, and ends of names of hosts and of files.
BEFORE_ITEMS = "see at from in file doi id version with of link to and the page the paper commit number order mail contact by call code using".split()
COMMON = "get set element by id http request response client file path user name list page count max min data index open read write parse json text node value item type load save error test main core util inter nation general part order time".split()
HOSTS, FILES = ("com", "org", "net", "edu", "io", "de", "fr"), ("py", "txt", "html", "json", "csv", "js", "pdf", "md", "log", "png")
#: Tokens in a stretch that is trained on: longer windows are cut. Stretches of a kind for each document of the sample.
STRETCH, EACH = 256, 50
#: Tasks that sum gradients.
TASKS = 8


def _drawn(rng: random.Random, words: list[str]) -> str:
    """A random secret: one run, groups with a joining mark, or words in one."""
    of = rng.choice(ALPHABETS)
    run = lambda n: "".join(rng.choice(of) for _ in range(n))
    draw = rng.random()
    if draw < 0.5:  # words or syllables, all in one
        syllable = lambda: rng.choice("bcdfghjklmnprstvwyz") + rng.choice("aeiouaeiouoeai") + rng.choice(("", "", "n", "r", "l", "s", "t", "ck", "ng", "m"))
        long = [w.lower() for w in words if len(w) > 3 and w.isascii()] if rng.random() < 0.4 else []
        glued = "".join(rng.choices(long, k=2))[:24] if long else "".join(syllable() for _ in range(rng.randint(3, 6)))
        glued = glued if len(glued) > 8 else glued + "".join(syllable() for _ in range(3))
        return glued + ("" if rng.random() < 0.7 else str(rng.randint(0, 9999)))
    if draw < 0.75:
        return run(rng.randint(8, 14) if rng.random() < 0.4 else rng.randint(10, 44))
    mark = rng.choice("-_./")
    return mark.join(["".join(rng.choice(ALPHABETS[1][:26]) for _ in range(rng.randint(2, 5))) if k == 0 and rng.random() < 0.5 else run(rng.randint(4, 16)) for k in range(rng.randint(2, 4))])


def _ordinary(rng: random.Random, words: list[str]) -> str:
    """An item with the look of a key that is none: a link, a path, an identifier, a version, a number."""
    word = lambda: rng.choice(words if rng.random() < 0.5 else COMMON).lower()[:14]
    digits = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    mixed = lambda n: "".join(rng.choice(ALPHABETS[rng.choice((0, 1, 2))]) for _ in range(n))
    hexes = lambda n: "".join(rng.choice(ALPHABETS[0]) for _ in range(n))
    host = lambda: f"{rng.choice(('', '', 'www.', word() + '.'))}{word()}.{rng.choice(HOSTS)}"
    name = lambda: "".join(w.capitalize() if k else w for k, w in enumerate(word() for _ in range(rng.randint(2, 4))))
    file = lambda: f"{rng.choice((word(), name(), word() + '_' + word(), word() + digits(2)))}.{rng.choice(FILES)}"
    link = lambda: f"{rng.choice(('https://', 'http://', 'https://', 'ftp://', ''))}{host()}"
    return rng.choice([
        lambda: f"{link()}/{word()}/{rng.choice((digits(6), mixed(11), word() + '-' + digits(5), file()))}",
        lambda: f"{link()}/{word()}?{rng.choice(('v', 'id', 'q', 'p', word()))}={mixed(rng.randint(6, 16))}",
        lambda: f"{link()}/{word()}/{word()}#{word()}{rng.choice(('', '&t=' + digits(3)))}",
        lambda: f"/{'/'.join(rng.choice((word(), word(), word() + digits(1), 'python3.' + digits(2))) for _ in range(rng.randint(1, 5)))}/{file()}",
        lambda: f"{rng.choice(('./', '~/', '../', ''))}{word()}/{word()}/{file()}",
        lambda: f"C:\\{word().capitalize()}\\{word()}\\{file()}",
        lambda: f"10.{digits(4)}/{rng.choice((word() + '.' + digits(4) + '.' + digits(6), 's' + digits(5) + '-' + digits(3) + '-' + digits(4) + '-' + digits(1), mixed(4) + '-' + digits(4)))}",
        lambda: "-".join(hexes(n) for n in (8, 4, 4, 4, 12)),
        lambda: "-".join(hexes(n) for n in (8, 4, 4, 4, 12)).upper(),
        lambda: f"{rng.choice(('v', '', word() + '-', word() + '=='))}{digits(1)}.{digits(rng.randint(1, 2))}.{digits(rng.randint(1, 3))}{rng.choice(('', '-rc' + digits(1), '-beta.' + digits(2), '+build.' + digits(4), '.dev' + digits(3), '-' + hexes(7)))}",
        lambda: f"{word()}{rng.choice(('.', '_', ''))}{rng.choice((word(), digits(2)))}@{host()}",
        lambda: f"{name()}{rng.choice(('', '()', '(' + word() + ')', '.' + name() + '()'))}",
        lambda: f"{rng.choice(('', rng.choice(COMMON).upper()))}{name()[:1].upper()}{name()[1:]}",
        lambda: "_".join(word() for _ in range(rng.randint(2, 4))).upper(),
        lambda: f"20{digits(2)}-0{rng.randint(1, 9)}-1{digits(1)}T0{digits(1)}:{digits(2)}:{digits(2)}Z",
        lambda: f"978-{digits(1)}-{digits(2)}-{digits(6)}-{digits(1)}",
        lambda: f"{rng.choice(('INV', 'REF', 'RFC', 'CVE-20' + digits(2), word()[:3].upper()))}-{digits(rng.randint(3, 8))}",
        lambda: f"arXiv:{digits(4)}.{digits(5)}v{digits(1)}",
        lambda: hexes(rng.randint(7, 12)),
        lambda: ":".join(hexes(2) for _ in range(6)),
        lambda: f"+{digits(2)} {digits(3)} {digits(7)}",
        lambda: digits(rng.randint(4, 16)),
        lambda: f"{digits(3)}.{digits(2)}.{digits(1)}.{digits(3)}",
        lambda: rng.choice((str.capitalize, str.lower))("".join(word() for _ in range(rng.randint(3, 6)))),
        lambda: f"{word()}={rng.choice((digits(3), word(), name()))}",
    ])()


def renamed(text: str, span: tuple[int, int, int], rng: random.Random) -> Iterator[tuple[str, list[tuple[int, int]]]]:
    """(text, places of secrets): the neighbourhood of a base span (start, end, start of the secret) with other names, joints
    and drawn secrets; with the text's own words in the secret's place; and with ordinary items after ordinary words or,
    now and then, after a name: these are none."""
    start, end, _ = span
    before, after = text[max(0, start - 100) : start], text[end : end + 60]
    words = [w for w in (before + " " + after).split() if w.isalpha() and w.isascii()] or ["other"]
    for k in range(5):
        head = before + (rng.choice(OTHER_NAMES) if k != 2 else rng.choice(words)) + rng.choice(JOINTS)
        body = _drawn(rng, words) if k < 3 else rng.choice(words)[:7]
        if k == 2 and body.isalpha() and body.islower():
            body += "9" + body[:5].upper()  # no name: words alone would be no secret
        yield f"{head}{body}{after}", [(len(head), len(head) + len(body))] if k < 3 else []
    for k in range(8):
        lead = rng.choice(words) if k < 3 else rng.choice(BEFORE_ITEMS) if k < 7 else f"{rng.choice(OTHER_NAMES)} {rng.choice(BEFORE_ITEMS)}"
        yield f"{before}{lead}{rng.choice((' ', ' ', ' ', ': ', ' (', ' = '))}{_ordinary(rng, words)}{rng.choice(('', '.', ',', ')'))}{after if after[:1].isspace() else ' ' + after}", []


def _gaps(text: str, rng: random.Random, most: int = 3) -> list[tuple[int, int, int]]:
    """Some gaps between words, as places that a secret or an ordinary item may be written in."""
    places = [m.start() for m in re.finditer(r"(?<=[a-z]) (?=[A-Za-z])", text[:20_000])]
    return [(p + 1, p, p) for p in sorted(rng.sample(places, min(most, len(places))))]


def _examples(rows: DataFrame, bits: int) -> DataFrame:
    """(at, kind, flat, counts, may, tags) from (doc, text, source): stretches of windows as arrays, with their tags; kind: 0
    without and 1 with a secret, 2 renamed, 3 renamed without. at: a hash to choose by."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = Codes(bits)
        for batch in batches:
            out = []

            def add(name: str, text: str, source: str | None, secrets: list[tuple[int, int]], kinds: tuple[int, int], only: int | None = None) -> None:
                for n, window in enumerate(windows(text, source, codes)):
                    if only is not None and not window.spans[0][0] <= only <= window.spans[-1][1]:
                        continue
                    tags = tags_of(window, secrets)
                    for low in range(0, len(tags), STRETCH):
                        part = slice(low, low + STRETCH)
                        some = window.features[part]
                        example = (np.array([x for f in some for x in f], "<i4").tobytes(), bytes(map(len, some)), window.may[part].astype(np.uint8).tobytes(), bytes(tags[part]))
                        out.append((xxhash.xxh3_64_intdigest(f"{name}|{n}|{low}") >> 1, kinds[any(tags[part])], *example))

            for doc, text, source in zip(*(c.to_pylist() for c in batch.columns[:3])):
                base = base_spans(text)
                add(str(doc), text, source, [(a, e) for _, _, e, a in base], (0, 1))
                for n, (s, e, a) in enumerate([(s, e, a) for _, s, e, a in base] + _gaps(text, random.Random(f"{doc}"))):
                    for k, (other, secrets) in enumerate(renamed(text, (s, e, a), random.Random(f"{doc}|{n}"))):
                        known = [(x, y) for _, _, y, x in base_spans(other)]  # of the neighbourhood's own, too
                        add(f"{doc}|{n}|{k}", other, source, [*secrets, *known], (3, 2), min(s, 100))
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], kind) for i, kind in enumerate((pa.int64(), pa.int64(), *[pa.binary()] * 4))], ["at", "kind", "flat", "counts", "may", "tags"])

    return rows.mapInArrow(run, "at long, kind long, flat binary, counts binary, may binary, tags binary")


def train(docs: DataFrame, sample: int = 400, bits: int = 16, rounds: int = 25, decay: float = 0.05, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> Field:
    """A field from the base patterns' spans.

    It learns from the `sample` documents of least hash that may hold a span and as many others with a likely place: from all
    their windows, cut into stretches of STRETCH tokens, and from rewritten ones. Of each kind (with and without a secret,
    rewritten with and without) the EACH * sample of least hash count, should there be more. Stretches stay with the
    executors: each step of the fit is a job that sums their gradients, and what comes back has the weights' size.
    Without any span, the field tags nothing."""
    source = F.col(source_col) if source_col in docs.columns else F.lit(None).cast("string")
    rows = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text"), source.cast("string").alias("source")).where("doc IS NOT NULL AND text IS NOT NULL")
    hints = F.col("text").rlike("AKIA[A-Z0-9]{16}") | F.col("text").rlike("[0-9a-f]{24}") | F.col("text").rlike(r"(?i)(?:passw|secret|token|api_?key).{0,12}[:=]")
    picked = stash(rows.where(F.col("text").rlike(LIKELY.pattern)).select("doc", hints.alias("hint"), F.xxhash64("doc").alias("at")), "picked")  # texts are searched once
    chosen = [picked.where(which).orderBy("at", "doc").limit(sample).select("doc") for which in (F.col("hint"), ~F.col("hint"))]
    ids = chosen[0].unionByName(chosen[1]).distinct()  # only ids are sorted; the few texts are then fetched by them
    made = stash(_examples(rows.join(F.broadcast(ids), "doc", "left_semi").repartition(TASKS, "doc"), bits), "examples")
    sizes = {r["kind"]: r["n"] for r in made.groupBy("kind").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not sizes.get(1):
        return Field(bits)
    cut = F.lit(True)
    for kind, n in sizes.items():
        if n > EACH * sample:  # hashes alone are sorted
            cut = cut & ((F.col("kind") != kind) | (F.col("at") <= made.where(F.col("kind") == kind).select("at").orderBy("at").limit(EACH * sample).agg(F.max("at")).first()[0]))
    used, spark = stash(made.where(cut).repartition("at"), "stretches"), docs.sparkSession

    def value(x: np.ndarray) -> tuple[float, np.ndarray]:
        sent = spark.sparkContext.broadcast(x.astype(np.float32))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            weights, steps = sent.value[:-9].astype(np.float64).reshape(-1, 3), sent.value[-9:].astype(np.float64).reshape(3, 3)
            loss, by_weights, by_steps = 0.0, np.zeros_like(weights), np.zeros((3, 3))
            for batch in batches:
                for low in range(0, batch.num_rows, 2000):
                    flat, counts, may, tags = (column.to_pylist() for column in batch.slice(low, 2000).columns)
                    join = lambda parts, kind: np.frombuffer(b"".join(parts), kind).astype(np.int64)
                    one, g, h = batch_gradient(weights, steps, join(flat, "<i4"), join(counts, np.uint8), np.array([len(t) for t in tags]), join(may, np.uint8) > 0, join(tags, np.uint8))
                    loss, by_weights, by_steps = loss + one, by_weights + g, by_steps + h
            yield pa.RecordBatch.from_arrays([pa.array([loss]), pa.array([np.concatenate([by_weights.ravel(), by_steps.ravel()]).astype(np.float32).tobytes()], pa.binary())], ["loss", "gradient"])

        parts = used.select("flat", "counts", "may", "tags").coalesce(TASKS).mapInArrow(run, "loss double, gradient binary").collect()  # TASKS rows at most
        sent.destroy()
        return sum(r["loss"] for r in parts) + decay * float(x @ x) / 2, np.sum([np.frombuffer(r["gradient"], np.float32) for r in parts], axis=0, dtype=np.float64) + decay * x

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(1 << bits, np.int64)
        for batch in batches:
            n += np.bincount(np.frombuffer(b"".join(batch.column(0).to_pylist()), "<i4"), minlength=1 << bits)
        yield pa.RecordBatch.from_arrays([pa.array([n.tobytes()], pa.binary())], ["n"])

    # Steps are taken in weights scaled by how often their features are there: rare ones are as far from flat as common ones.
    often = np.sum([np.frombuffer(r["n"], np.int64) for r in used.select("flat").coalesce(TASKS).mapInArrow(count, "n binary").collect()], axis=0)
    scale = np.concatenate([np.repeat(1 / np.sqrt(often / 4 + 1), 3), np.full(9, 1 / np.sqrt(often.max() / 4 + 1))])

    def scaled(z: np.ndarray) -> tuple[float, np.ndarray]:
        loss, gradient = value(z * scale)
        return loss, gradient * scale

    release(spark)
    x = minimised(scaled, np.zeros(3 * (1 << bits) + 9), rounds) * scale
    release(spark)  # every step collected gradients
    return Field(bits, x[:-9].reshape(-1, 3), x[-9:].reshape(3, 3))


def learned_spans(model: Field, text: str, source: str | None, taken: list[tuple[int, int]], least: int = 6) -> list[tuple[int, int]]:
    """What the field tags, of `least` characters or more (what an assignment's secret has), apart from the spans taken."""
    found = []
    for window in windows(text, source, model.codes):
        tags = model.viterbi(window)
        for i, tag in enumerate(tags):
            if tag == BEGIN:
                last = i
                while last + 1 < len(tags) and tags[last + 1] == INSIDE:
                    last += 1
                a, b = window.spans[i][0], window.spans[last][1]
                if b - a >= least and not any(a < y and b > x for x, y in taken):
                    found.append((a, b))
    return found


def scan_secrets(docs: DataFrame, model: Field | None = None, sample: int = 400, mark: str = "<secret>", with_text: bool = False, carry: bool = False, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, n_learned, base (array of kind, start, end; code points, end exclusive), all_spans
    (the same with the learned ones) and, if asked for, redacted: the text with `mark` in place of every secret, and every
    column of docs, its name after "in_" (carry).

    One row for each row of docs. A null text is empty and holds none. The field is trained on docs unless given; the
    source column may be missing or null.
    """
    model = model or train(docs, sample, id_col=id_col, text_col=text_col, source_col=source_col)
    sent = docs.sparkSession.sparkContext.broadcast((model.bits, model.weights.astype(np.float32), model.steps))
    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
    kinds = [pa.int64()] * 4 + [span, span] + [pa.string()] * with_text
    names = ["doc_id", "n_assign", "n_access", "n_hex", "n_learned", "base", "all_spans", *["redacted"] * with_text]
    carried = [(c, kind) for c, kind in docs.dtypes] if carry else []
    names += [f"in_{c}" for c, _ in carried]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field = Field(*sent.value)
        active = bool(np.any(field.weights))
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part, out = batch.slice(at, 1000), []
                for text, source in zip(part.column(1), part.column(2)):
                    text, source = text.as_py() or "", source.as_py()
                    base = base_spans(text)
                    more = [(LEARNED, a, b, a) for a, b in learned_spans(field, text, source, [(x, y) for _, x, y, _ in base])] if active else []
                    every = sorted(base + more, key=lambda s: (s[1], ORDER[s[0]]))
                    counts = [sum(s[0] == k for s in every) for k in ORDER]
                    row = [*counts, *[[{"kind": k, "start": a, "end": b} for k, a, b, _ in spans] for spans in (base, every)]]
                    if with_text:
                        pieces, done = [], 0
                        for _, _, b, a in sorted(every, key=lambda s: s[3]):
                            if a >= done:
                                pieces += [text[done:a], mark]
                            done = max(done, b)
                        row.append("".join([*pieces, text[done:]]))
                    out.append(row)
                yield pa.RecordBatch.from_arrays([part.column(0), *[pa.array(c, k) for c, k in zip(zip(*out), kinds)], *part.columns[3:]], names)

    schema = "doc_id long, n_assign long, n_access long, n_hex long, n_learned long, base array<struct<kind:string,start:long,end:long>>, all_spans array<struct<kind:string,start:long,end:long>>"
    source = F.col(source_col) if source_col in docs.columns else F.lit(None)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), source.cast("string").alias("source"), *[F.col(c).alias(f"in_{c}") for c, _ in carried])
    return rows.mapInArrow(run, schema + ", redacted string" * with_text + "".join(f", `in_{c}` {kind}" for c, kind in carried))
