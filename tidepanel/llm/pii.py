"""Surrogates for personal data.

E-mail addresses, telephone, card and identity numbers, IP addresses, secrets
and person names are detected in whole texts.  Each is reduced to a canonical
form (digits alone, lower case, name parts), so that mentions in different
formats are one entity; a keyed function of the canonical form gives its
surrogate, and the mention's own format (separators, case, script, gender of a
given name, country prefix, labels of a domain, kinds of characters, validity of
a check digit) is laid over it.  Digits go through a keyed Feistel permutation,
so numbers of one shape never collide; the distinct entities of the whole corpus
are nevertheless checked: a surrogate that two entities share, or that is itself
an entity, is drawn again with the next tweak.  The few redrawn ones are
broadcast.

A person is a title and one or two names, or a listed given name and a family
name.  Where a text has such a full mention, its names are also taken where they
stand alone.  Other lone given names are not taken for persons, as they may be
ordinary words.  A name's gender is that of the list, else of its title; its
surrogate is of the script it is in.

Null texts stay null, texts without entities are unchanged, rows that repeat are
treated alike, an empty table gives no rows, columns beside the text are passed
on.  A text is looked at whole, one at a time.
"""

from __future__ import annotations

import bisect
import functools
import hashlib
import hmac
import ipaddress
import itertools
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import runtime
from . import textops as X

#: redrawn surrogates that are broadcast; more are an error of the key, not of the data
REDRAWN = 1_000_000

# Given names by script and gender, titles by gender
GIVEN = {
    ("latin", "f"): "Anna Maria Laura Julia Sarah Emma Sophie Claire Camille Elena Lucia Carmen Isabel Katharina Johanna Susanne Margaret Elizabeth Jennifer Patricia Nicole Charlotte Helena Monika".split(),
    ("latin", "m"): "John James Robert Michael David Thomas Peter Stefan Andreas Wolfgang Pierre Laurent Nicolas Philippe Carlos Javier Miguel Antonio Fernando William Richard Christopher Daniel Matthias".split(),
    ("cyrillic", "f"): "Анна Мария Елена Ольга Наталья Татьяна Ирина Светлана Екатерина Юлия".split(),
    ("cyrillic", "m"): "Иван Александр Дмитрий Сергей Андрей Алексей Михаил Николай Владимир Павел".split(),
}
TITLES = {"f": "Mrs Ms Miss Frau Madame Mme Señora Sra Signora Госпожа".split(), "m": "Mr Herr Monsieur Señor Sr Signor Господин".split(), "": "Dr Prof".split()}
_SYLLABLES = {"latin": "ba be bo da de do fa fe ga go ha ka ko la le lo ma me mo na ne no pa pe ra re ro sa se so ta te to va ve vo wa".split(), "cyrillic": "ба бе во га да ко ла ле ло ма ме мо на не но ра ре ро са се со та то".split()}
#: ends of family names, and of given names by gender
_ENDS = {
    ("latin", "family"): "ck ll mann n r rn s sen tt x".split(), ("cyrillic", "family"): "в н р к".split(),
    ("latin", "f"): "lia na nia ra tte".split(), ("latin", "m"): "bert mund ric ton win".split(), ("latin", ""): "lin ny rey sse".split(),
    ("cyrillic", "f"): "ла на ра я".split(), ("cyrillic", "m"): "мир рад слав тин".split(), ("cyrillic", ""): "ль нь".split(),
}
_HAN = "王李张刘陈杨赵黄周吴徐孙胡朱高林何郭马罗明华强伟芳娜敏静丽军文平"
#: labels below a country's that are part of a public suffix
_SECOND = "ac co com edu gov net org".split()
#: country codes of two digits; those that begin with 1 or 7 have one, all others three
_CODES = {*map(str, [20, 27, *range(30, 35), 36, 39, 40, 41, *range(43, 50), *range(51, 59), *range(60, 67), 81, 82, 84, 86, *range(90, 96), 98])}

_names = {n.lower(): key for key, names in GIVEN.items() for n in names}
_titles = {n.lower(): g for g, names in TITLES.items() for n in names}
_CAPITAL = r"(?:[^\W\d_a-zß-öø-ÿа-я])[^\W\d_]+"

PATTERN = re.compile(
    r"(?P<email>(?<![\w.+-])[\w.+-]*\w@[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?(?:\.[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?)+)"
    r"|(?P<secret>(?i:(?:token|secret|password|passwd|api[_-]?key|access[_-]?key)\s*[=:]\s*[\"']?)(?P<value>[A-Za-z0-9+/_-]{16,}))"
    r"|(?P<card>(?<![\d.-])\d{4}(?P<sep>[ -]?)\d{4}(?P=sep)\d{4}(?P=sep)\d{3,4}(?![\d-]))"
    r"|(?P<identity>(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-]))"
    r"|(?P<ip>(?<![\d.])(?:25[0-5]|2[0-4]\d|1?\d?\d)(?:\.(?:25[0-5]|2[0-4]\d|1?\d?\d)){3}(?![\d.]*\d))"
    r"|(?P<ip6>(?<![\w:.])(?=[0-9A-Fa-f:]*::|(?:[0-9A-Fa-f]{1,4}:){7})[0-9A-Fa-f:]{3,39}(?![\w:]))"
    r"|(?P<phone>(?<![\w+])(?:\+\d{8,14}(?![\w-])|(?:\+\d{1,3}[ .-]?)?(?:\(\d{2,4}\)[ .-]?|\d{2,4}[ .-])\d{3,4}[ .-]?\d{3,4}(?![\w-])))"
)
_TITLE = "|".join(n for names in TITLES.values() for n in names)
_KNOWN = "|".join(x for names in GIVEN.values() for n in names for x in (n, n.upper()))
#: a title and one or two names, or a listed given name and a family name
NAMES = re.compile(
    rf"\b(?:(?P<title>{_TITLE})\.?[ ](?P<given>{_CAPITAL})(?:[ ](?P<family>{_CAPITAL}(?:-{_CAPITAL})?))?"
    rf"|(?P<first>{_KNOWN})[ ](?P<last>{_CAPITAL}(?:-{_CAPITAL})?))(?![\w@])"
)


def _mac(key: bytes, *parts: str) -> bytes:
    return hmac.new(key, "\x1f".join(parts).encode(), hashlib.sha256).digest()


def permuted(key: bytes, tweak: str, digits: str) -> str:
    """Keyed permutation of digit strings of one length: an unbalanced Feistel network of ten rounds."""
    n = len(digits)
    if n == 1:
        order = sorted(range(10), key=lambda d: _mac(key, tweak, "one", str(d)))
        return str(order[int(digits)])
    u = n // 2
    a, b = digits[:u], digits[u:]
    for r in range(10):
        f = int.from_bytes(_mac(key, tweak, str(n), str(r), b)[:16], "big")
        a, b = b, str((int(a) + f) % 10 ** len(a)).zfill(len(a))
    return a + b


def luhn(digits: str) -> int:
    """Sum of the Luhn check modulo 10; 0: valid."""
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        d = 2 * d if i % 2 else d
        total += d - 9 if d > 9 else d
    return total % 10


def _use(ip: str) -> str:
    a = ipaddress.IPv4Address(ip)
    return "special" if a.is_multicast or a.is_reserved else "private" if a.is_private else "public"


@functools.lru_cache(1 << 16)
def surrogate(key: bytes, kind: str, canon: str, attempt: int = 0) -> str:
    """Canonical surrogate of a canonical entity."""
    tweak = f"{kind}/{attempt}"
    if kind in ("phone", "identity"):
        x = permuted(key, tweak, canon)
        while x[0] == "0" != canon[0]:  # walks on: a number without a leading zero stands for one
            x = permuted(key, tweak, x)
        return x
    if kind == "card":
        if luhn(canon) == 0:
            body = permuted(key, tweak, canon[:-1])
            return body + str(-luhn(body + "0") % 10)
        x = permuted(key, tweak + "x", canon)
        while luhn(x) == 0:  # walks on within numbers that fail the check
            x = permuted(key, tweak + "x", x)
        return x
    if kind == "ip":
        kept = _use(canon)
        x = int(ipaddress.IPv4Address(canon))
        while True:  # a permutation of 32 bits, walked on within addresses of one use
            hi, lo = x >> 16, x & 0xFFFF
            for r in range(8):
                hi, lo = lo, hi ^ int.from_bytes(_mac(key, tweak, str(r), str(lo))[:2], "big")
            x = (hi << 16) | lo
            out = str(ipaddress.IPv4Address(x))
            if _use(out) == kept:
                return out
    if kind == "ip6":
        x = int(ipaddress.IPv6Address(canon))
        mask = (1 << 56) - 1
        hi, lo = (x >> 56) & mask, x & mask
        for r in range(8):  # a permutation of the bits below the prefix, which keeps an address of its use
            hi, lo = lo, hi ^ int.from_bytes(_mac(key, tweak, str(r), str(lo))[:7], "big")
        return str(ipaddress.IPv6Address((x >> 112 << 112) | (hi << 56) | lo))
    if kind == "email":
        local, domain = canon.rsplit("@", 1)
        return f"{_characters(key, tweak + '/local', local, canon)}@{_domain(key, tweak, domain)}"
    if kind == "secret":
        return _characters(key, tweak, canon, canon, re.fullmatch("[0-9a-f]+|[0-9A-F]+", canon) is not None)
    script, gender, name = canon.split("/", 2)
    if kind == "given":
        own = [n.lower() for n in GIVEN[script, gender]]
        order = sorted(own, key=lambda n: _mac(key, tweak, script, gender, n))
        # one keyed cycle through the list: no name stands for itself
        return f"{script}/{gender}/{order[(order.index(name) + 1) % len(order)]}"
    return f"{script}/{gender}/{_name(key, tweak, script, 'family' if kind == 'family' else gender, name)}"


def _stream(key: bytes, *parts: str):
    for i in itertools.count():
        yield from _mac(key, *parts, str(i))


def _characters(key: bytes, tweak: str, shape: str, of: str, hexadecimal: bool = False) -> str:
    """Keyed characters of the same kinds: digits, letters of a case and script; others are kept."""
    x, out = _stream(key, tweak, of), []
    for c in shape:
        if c.isdigit():
            out.append(str(next(x) % 10))
        elif c.isalpha():
            letters = "abcdef" if hexadecimal else _letters(c.lower())
            y = letters[(next(x) << 8 | next(x)) % len(letters)]
            out.append(y.upper() if c.isupper() else y)
        else:
            out.append(c)
    return "".join(out)


def _domain(key: bytes, tweak: str, domain: str) -> str:
    """A domain of as many labels; a label has one surrogate under one public suffix, which stays."""
    labels = domain.split(".")
    public = 2 if len(labels) > 2 and len(labels[-1]) == 2 and labels[-2] in _SECOND else 1
    suffix = ".".join(labels[-public:])
    return ".".join([*(_characters(key, f"{tweak}/label/{suffix}", x, x) for x in labels[:-public]), suffix])


def country(digits: str) -> int:
    """How many leading digits of an international number are its country code."""
    return 1 if digits[0] in "17" else 2 if digits[:2] in _CODES else 3


@functools.lru_cache(4096)
def _letters(c: str) -> str:
    """Letters that may stand for the lower-case letter c: those of its script."""
    if "a" <= c <= "z":
        return "abcdefghijklmnopqrstuvwxyz"
    if "一" <= c <= "鿿":
        return _HAN
    start, size = (0xAC00, 0x2BA4) if "가" <= c <= "힣" else (ord(c) & ~0x7F, 0x80)
    own = [chr(x) for x in range(start, start + size) if chr(x).isalpha() and chr(x).islower() == c.islower() and not chr(x).isupper() and len(chr(x).upper()) == 1]
    return "".join(own) or c


def _name(key: bytes, tweak: str, script: str, what: str, name: str) -> str:
    if script not in _SYLLABLES:
        return _characters(key, f"{tweak}/{what}", name, name)
    m = _mac(key, tweak, script, what, name)
    s, e = _SYLLABLES[script], _ENDS[script, what]
    return "".join(s[m[i] % len(s)] for i in range(4 if what == "family" else 3)) + e[m[5] % len(e)]


def _script(word: str) -> str:
    c = word[0].lower()
    return "cyrillic" if "Ѐ" <= c <= "ӿ" else "latin" if c < "ɐ" else "other"


def _like(word: str, shape: str) -> str:
    """word in the letter case of shape."""
    return word.upper() if len(shape) > 1 and shape.isupper() else word[:1].upper() + word[1:] if shape[:1].isupper() else word


def _digits_like(digits: str, shape: str) -> str:
    it = iter(digits)
    return "".join(next(it) if c.isdigit() else c for c in shape)


def mentions(text: str, names: bool = True) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, canonical form) of every entity, in order."""
    out = []
    for m in PATTERN.finditer(text):
        kind = m.lastgroup if m.lastgroup not in ("value", "sep") else "secret" if m["secret"] else "card"
        start, end = m.span(kind)
        if kind == "email":
            out.append((start, end, kind, m[kind].lower()))
        elif kind == "secret":
            out.append((*m.span("value"), kind, m["value"]))
        elif kind in ("card", "identity"):
            out.append((start, end, kind, re.sub(r"\D", "", m[kind])))
        elif kind == "ip":
            out.append((start, end, kind, ".".join(str(int(x)) for x in m[kind].split("."))))
        elif kind == "ip6":
            try:
                out.append((start, end, kind, str(ipaddress.IPv6Address(m[kind]))))
            except ValueError:
                pass
        else:
            if m[kind][0] == "+":
                digits = re.match(r"\+(\d+)", m[kind])[1]
                start += 1 + (country(digits) if len(digits) > 3 else len(digits))
                start += re.match(r"[ .-]*", text[start:end]).end()
            national = re.sub(r"\D", "", text[start:end])
            # a trunk zero is part of the format
            if 7 <= len(national) <= 12:
                if national[0] == "0":
                    start = text.index("0", start) + 1
                    national = national[1:]
                out.append((start, end, "phone", national))
    if not names:
        return out
    taken = [(a, z) for a, z, *_ in out]
    people: dict[str, tuple[str, str]] = {}
    for m in NAMES.finditer(text):
        if any(a < m.end() and m.start() < z for a, z in taken):
            continue
        given, family = ("given", "family") if m["title"] else ("first", "last")
        known = _names.get(m[given].lower())
        script = _script(m[given])
        if known:
            entity = ("given", f"{known[0]}/{known[1]}/{m[given].lower()}")
        elif m[family]:
            entity = ("called", f"{script}/{_titles[m['title'].lower()]}/{m[given].lower()}")
        else:
            # after a title alone stands a family name
            entity = ("family", f"{script}//{m[given].lower()}")
        out.append((*m.span(given), *entity))
        people.setdefault(m[given].lower(), entity)
        if m[family]:
            entity = ("family", f"{_script(m[family])}//{m[family].lower()}")
            out.append((*m.span(family), *entity))
            people[m[family].lower()] = entity
    if people:
        # names of a full mention, where they stand alone
        taken = sorted((a, z) for a, z, *_ in out)
        starts = [a for a, _ in taken]
        words = sorted(people, key=lambda n: (-len(n), n))
        for m in re.finditer(rf"(?<![\w@.-])(?:{'|'.join(map(re.escape, words))})(?![\w@])", text, re.IGNORECASE):
            i = bisect.bisect_right(starts, m.start())
            if (i and taken[i - 1][1] > m.start()) or (i < len(taken) and taken[i][0] < m.end()) or m[0][0].islower():
                continue
            out.append((*m.span(), *people[m[0].lower()]))
    return sorted(out)


def dressed(shape: str, kind: str, canon: str) -> str:
    """A canonical surrogate in a mention's own format."""
    if kind in ("phone", "card", "identity"):
        return _digits_like(canon, shape)
    if kind in ("given", "called", "family"):
        return _like(canon.split("/", 2)[2], shape)
    if kind in ("email", "ip6"):
        return canon.upper() if shape.isupper() else canon
    return canon


#: every kind of PATTERN holds one of these: an address its @, a secret or IPv6 address = or :, the others digits
_SIGNS = np.zeros(256, dtype=bool)
_SIGNS[[*range(0x30, 0x3A), 0x40, 0x3D, 0x3A]] = True
#: what NAMES begins with, a title or a given name as listed or in capitals: the last bytes, at most eight, by their number
_ENDINGS = {
    n: np.unique(np.array([int.from_bytes(x[-n:], "big") for x in found], np.uint64))
    for n, found in ((n, [x for x in map(str.encode, f"{_TITLE}|{_KNOWN}".split("|")) if min(len(x), 8) == n]) for n in range(1, 9))
    if found
}
#: digits beyond ASCII, which \d takes too, and the first bytes that they can have
_DIGITS = re.compile(r"[^\D0-9]")
_WIDE = np.arange(256) >= 0xD9
_WIDE[0xE2] = False


def _named(buf: np.ndarray) -> np.ndarray:
    """Positions of blanks that follow a title or given name, whatever stands before it."""
    at = np.flatnonzero(buf == 0x20)
    end = at - (buf[at - 1] == 0x2E)
    key = np.zeros(len(at), np.uint64)
    for j in range(8):
        key |= np.where(end > j, buf[end - 1 - j], 0).astype(np.uint64) << np.uint64(8 * j)
    hit = np.zeros(len(at), dtype=bool)
    for n, known in _ENDINGS.items():
        hit |= X.lookup(known, key & np.uint64((1 << (8 * n)) - 1)) >= 0
    return at[hit]


def _texts(column):
    """(row, text, may hold names) of the rows that may hold an entity: all that ``mentions`` finds are in them."""
    batch = pa.RecordBatch.from_arrays([column], names=["t"])
    buf_all, offs_all = X.column(batch, 0)
    for i, j in X.slices(offs_all):
        buf, offs = buf_all[offs_all[i] : offs_all[j]], offs_all[i : j + 1] - offs_all[i]
        raw = buf.tobytes()
        named = np.zeros(j - i, dtype=bool)
        named[np.searchsorted(offs, _named(buf), side="right") - 1] = True
        some = named.copy()
        some[np.searchsorted(offs, np.flatnonzero(_SIGNS[buf]), side="right") - 1] = True
        wide = np.zeros(j - i, dtype=bool)
        wide[np.searchsorted(offs, np.flatnonzero(_WIDE[buf]), side="right") - 1] = True
        for r in np.flatnonzero(some | wide).tolist():
            text = raw[offs[r] : offs[r + 1]].decode()
            if some[r] or _DIGITS.search(text):
                yield i + r, text, bool(named[r])


def entities(docs: DataFrame, text: str) -> DataFrame:
    """Distinct (kind, canon) of the corpus."""

    def run(batches):
        for b in batches:
            found = {(k, c) for _, t, named in _texts(b.column(0)) for _, _, k, c in mentions(t, named)}
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in found], pa.string()), pa.array([c for _, c in found], pa.string())], names=["kind", "canon"])

    return docs.select(F.col(text).cast("string")).mapInArrow(X.tidy(run), "kind string, canon string").distinct()


def drawn(rows: DataFrame, key: bytes) -> DataFrame:
    """kind, canon, attempt with the surrogate of each."""

    def run(batches):
        for b in batches:
            k, c, a = (b.column(i).to_pylist() for i in range(3))
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array([surrogate(key, *x) for x in zip(k, c, a)], pa.string())], names=["kind", "canon", "attempt", "surrogate"])

    return rows.select("kind", "canon", "attempt").mapInArrow(X.tidy(run), "kind string, canon string, attempt int, surrogate string")


def redraw(found: DataFrame, key: bytes, rounds: int = 20) -> DataFrame:
    """Surrogates of all entities, none shared and none an entity itself.

    Given names are a permutation of a closed list: they stand for each other.
    """
    all_, _ = runtime.written(found.filter("kind != 'given'").withColumn("attempt", F.lit(0)), "entities")
    table, _ = runtime.written(drawn(all_, key), "surrogates")
    for _ in range(rounds):
        least = table.groupBy("kind", "surrogate").agg(F.min(F.struct("attempt", "canon")).alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
        shared = table.join(least, ["kind", "surrogate"]).filter("struct(attempt, canon) != first").select("kind", "canon", "attempt")
        real = all_.select("kind", F.col("canon").alias("surrogate"))
        taken = table.join(real, ["kind", "surrogate"], "left_semi").select("kind", "canon", "attempt")
        bad, _ = runtime.written(shared.unionAll(taken).distinct(), "redrawn")
        if bad.isEmpty():
            return table
        fresh = drawn(bad.withColumn("attempt", F.col("attempt") + 1), key)
        table, _ = runtime.written(table.join(bad.select("kind", "canon"), ["kind", "canon"], "left_anti").unionByName(fresh), "surrogates")
    raise RuntimeError("surrogates did not become distinct")


def replace(docs: DataFrame, *, key: bytes, text: str = "text", result: str = "entities") -> DataFrame:
    """docs with surrogates in the text and an array column of (kind, start, end) in the new text."""
    before = runtime.mark()
    moved = redraw(entities(docs, text), key).filter("attempt > 0").select("kind", "canon", "attempt")
    rows = moved.limit(REDRAWN + 1).collect()
    if len(rows) > REDRAWN:
        raise RuntimeError("too many colliding surrogates; use another key")
    runtime.drop_since(docs.sparkSession, before)
    shared = docs.sparkSession.sparkContext.broadcast({(r["kind"], r["canon"]): r["attempt"] for r in rows})
    span = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
    schema = T.StructType([*docs.schema.fields, T.StructField(result, T.ArrayType(span))])
    at = docs.columns.index(text)

    def run(batches):
        again = shared.value
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        for b in batches:
            new: dict[int, str] = {}
            spans: list[list] = [[] for _ in range(b.num_rows)]
            for r, t, named in _texts(b.column(at)):
                found = mentions(t, named)
                if not found:
                    continue
                parts, left, size = [], 0, 0
                for a, z, k, c in found:
                    s = dressed(t[a:z], k, surrogate(key, k, c, again.get((k, c), 0)))
                    parts += [t[left:a], s]
                    size += a - left
                    spans[r].append({"kind": k, "start": size, "end": size + len(s)})
                    size += len(s)
                    left = z
                new[r] = "".join([*parts, t[left:]])
            column = b.column(at)
            if new:
                texts = column.to_pylist()
                for r, t in new.items():
                    texts[r] = t
                column = pa.array(texts, column.type)
            cols = list(b.columns)
            cols[at] = column
            made = pa.array(spans, kind)
            yield pa.RecordBatch.from_arrays([*cols, made], names=[*b.schema.names, result])

    return docs.mapInArrow(X.tidy(run), schema)


def report(docs: DataFrame, *, key: bytes) -> DataFrame:
    """doc_id, text with surrogates, n_entities and their kinds, of every row."""
    out = replace(docs.select("doc_id", "text"), key=key)
    return out.select("doc_id", "text", F.size("entities").cast("long").alias("n_entities"), F.array_join(F.array_sort(F.array_distinct("entities.kind")), ",").alias("kinds"))
