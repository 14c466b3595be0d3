"""Surrogate generation for personal data.

Detected entities get replacements that a key determines: the same value gets the same one everywhere (coreference),
other values get others (distinctness), and kind, gender, script and format stay.

- Numbers and codes go through a keyed permutation of all strings of their format, a Feistel network over the
  positions that may change: card numbers (long numbers with a valid check digit; others are none) keep length,
  separators, issuer and a valid check digit, phone numbers the country code and punctuation, addresses their public or
  private range, IBANs the country and a valid check number, e-mail addresses and secrets the class of every character.
- Names after a title, or a known given name with a family name, become given names with an ending of the same gender
  (a neutral one where nothing tells it) and a family name, of syllables in the same script. A name may have several
  words, initials and particles, which stay, as do hyphens and apostrophes: each part has its own surrogate. Capitals
  don't tell persons apart and are written as they were. Where a text has a family name, its other mentions in that text
  that begin with a capital are replaced too, unless the text has the same word in small letters.

Replacements are made where the text is, by computation alone. A table of the distinct values of the corpus is checked
for collisions: two values with one replacement, or a replacement that is itself a value of the corpus (given and
family names count as one kind here). All but one value (the smallest) of a collision are drawn again until none is
left. Names are drawn from a space that grows with every attempt; secrets and e-mail addresses become longer from
attempt LONGER on, as there may be more values of a short format than strings. The other formats can't grow: if a
corpus holds too many values of one, ValueError is raised. Exceptions go to the texts: as a list if there are at most
`most_sent`, else by a join on the row.

A null text stays null, an empty one stays empty. Rows with equal or null ids, repeated rows, empty tables and very
long texts need no special case. Other columns stay as they are, whatever their names.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkbasin.llm.common import free_names, give_back, small_batches, stored, table

KEY = b"inkbasin surrogates"
#: Titles with the gender they tell, given names by gender, syllables of family names by script.
MALE_TITLES = ("Mr", "Mister", "Sir", "Herr", "Monsieur", "Señor", "Sr", "Господин")
FEMALE_TITLES = ("Mrs", "Ms", "Miss", "Madam", "Frau", "Madame", "Mme", "Señora", "Sra", "Госпожа")
OTHER_TITLES = ("Dr", "Prof", "Professor", "Doktor", "Docteur", "Доктор")
MALE = ("James", "Robert", "Michael", "David", "Thomas", "Daniel", "Matthew", "Andrew", "Hans", "Klaus", "Jürgen", "Pierre", "Jacques", "François", "Carlos", "José", "Javier", "Иван", "Сергей", "Дмитрий")
FEMALE = ("Mary", "Patricia", "Jennifer", "Elizabeth", "Susan", "Sarah", "Karen", "Emily", "Ursula", "Greta", "Heidi", "Marie", "Camille", "Chloé", "Carmen", "Lucía", "Isabel", "Анна", "Мария", "Ольга")
SYLLABLES = {"LATIN": ("ba", "den", "for", "gra", "hol", "kin", "lam", "mor", "nel", "pas", "ril", "sten", "tor", "ver", "wick", "zan"), "CYRILLIC": ("ба", "ден", "гор", "зар", "кин", "лом", "мир", "нел", "пар", "рил", "сте", "тор", "вер", "жан", "чик", "шин"), "GREEK": ("βα", "δεν", "γορ", "ζαρ", "κιν", "λομ", "μιρ", "νελ", "παρ", "ριλ", "στε", "τορ", "φερ", "χαν", "ψικ", "θιν")}
PARTICLES = ("van", "der", "den", "de", "da", "di", "del", "della", "la", "le", "von", "zu", "zur", "al", "el", "bin", "ibn", "dos", "du", "ten", "ter")
#: What given names end with, by script and gender.
ENDINGS = {"LATIN": {"male": "o", "female": "a", "given": "e"}, "CYRILLIC": {"male": "ий", "female": "ия", "given": "и"}, "GREEK": {"male": "ος", "female": "α", "given": "ι"}}
_NAMES = ("male", "female", "given", "family")
#: The attempt from which secrets and e-mail addresses get more characters than they had.
LONGER = 8

def _ranges(of) -> str:
    """The letters that `of` is true for as ranges of a character class."""
    out, last = [], -2
    for c in filter(lambda c: of(chr(c)), range(0x250 * 64)):
        if c == last + 1:
            out[-1][1] = c
        else:
            out.append([c, c])
        last = c
    return "".join(f"{chr(a)}-{chr(b)}" if a < b else chr(a) for a, b in out)


_UPPER, _LETTER = f"[{_ranges(str.isupper)}]", r"[^\W\d_]"
#: A word of a name: O'Neil, Smith-Jones, SMITH.
_WORD = rf"{_UPPER}(?:['’]{_UPPER})?{_LETTER}+(?:[-'’]{_LETTER}+)*"
_INITIAL, _PARTICLE = rf"{_UPPER}\.", rf"(?:{'|'.join(PARTICLES)})"
_HEAD = rf"(?:{_INITIAL} ?){{0,3}}(?:{_PARTICLE} ){{0,3}}{_WORD}"
_TAIL = rf"(?: (?:{_INITIAL} ?){{0,2}}(?:{_PARTICLE} ){{0,3}}{_WORD})"
#: After these the next capital needn't belong to the name, as nouns have capitals too.
_GERMAN = ("Herr", "Frau", "Doktor")
_PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}",
    "iban": r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?\b",
    "secret": r"(?<=password=)\S+|(?<=passwd=)\S+|(?<=secret=)\S+|(?<=token=)\S+|(?<=[Pp]assword: )(?=\S*\d)\S+|(?<=api_key=)\S+|(?<=token = \")[^\"\n]+|(?<=secret = \")[^\"\n]+|(?<=password = \")[^\"\n]+|(?<=api_key = \")[^\"\n]+|\b(?:AKIA[0-9A-Z]{16}|ghp_[A-Za-z0-9]{36}|sk-[A-Za-z0-9]{20,})\b",
    "ip": r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\.){3}(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)(?!\.?\d)",
    "card": r"(?<![\d+-])(?:3[47]\d{2}[ -]?\d{6}[ -]?\d{5}|(?:[3-6]\d{3}|2[2-7]\d{2})(?:[ -]?\d{4}){2}[ -]?\d{1,7})(?![\d-])",
    "ssn": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "phone": r"(?<![\w+])\+\d{1,3}[ .-]?(?:\(\d{1,4}\)|\d{1,4})(?:[ .-]?\d{2,4}){2,4}(?!\w)|(?<![\w(])\(?[2-9]\d{2}\)?[ .-]\d{3}[ .-]\d{4}(?!\w)",
    "name": rf"\b(?:{'|'.join(_GERMAN)})\b\.? {_HEAD}{_TAIL}?|\b(?:{'|'.join(t for t in MALE_TITLES + FEMALE_TITLES + OTHER_TITLES if t not in _GERMAN)})\b\.? {_HEAD}{_TAIL}{{0,2}}|\b(?:{'|'.join(MALE + FEMALE)}){_TAIL}",
}
_FIND = re.compile("|".join(f"(?P<{k}>{p})" for k, p in _PATTERNS.items()))
#: What any of them needs; texts without it aren't searched.
_HINT = re.compile(r"[@\d=]|assword: |= \"|\b(?:" + "|".join(MALE_TITLES + FEMALE_TITLES + OTHER_TITLES + MALE + FEMALE) + r")\b")
_TITLE = re.compile(rf"(?P<title>{'|'.join(MALE_TITLES + FEMALE_TITLES + OTHER_TITLES)})\b\.? ")
_CLASSES = ("0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")


def _number(key: bytes, *parts: object) -> int:
    return int.from_bytes(hashlib.blake2b("\x1f".join(map(str, parts)).encode("utf-8", "replace"), key=key, digest_size=32).digest(), "big")


def permute(key: bytes, tweak: str, digits: list[int], radices: list[int]) -> list[int]:
    """A keyed permutation of the digit strings with these radices."""
    cut = len(digits) // 2
    sizes, halves = [1, 1], [0, 0]
    for i, (d, r) in enumerate(zip(digits, radices)):
        side = i >= cut
        halves[side] = halves[side] * r + d
        sizes[side] *= r
    for turn in range(10):
        side = turn & 1
        halves[side] = (halves[side] + _number(key, tweak, turn, halves[1 - side])) % sizes[side]
    out = [0] * len(digits)
    for i in range(len(digits) - 1, -1, -1):
        side = i >= cut
        halves[side], out[i] = divmod(halves[side], radices[i])
    return out


def _swap(key: bytes, tweak: str, text: str, fixed: set[int] = frozenset(), alphabet: str | None = None) -> str:
    """Permute the characters of each class in text, those at fixed places and of no class apart."""
    places, digits, sets = [], [], []
    for i, c in enumerate(text):
        own = alphabet if alphabet and c in alphabet else next((s for s in _CLASSES if c in s), None)
        if own and i not in fixed:
            places.append(i), digits.append(own.index(c)), sets.append(own)
    pattern = "".join("x" if i in places else c for i, c in enumerate(text))
    out = list(text)
    for i, d, s in zip(places, permute(key, f"{tweak}|{pattern}|{[len(s) for s in sets]}", digits, [len(s) for s in sets]), sets):
        out[i] = s[d]
    return "".join(out)


def _luhn(digits: str) -> int:
    """The check digit of digits."""
    total = sum(sum(divmod(2 * int(c), 10)) if i % 2 == 0 else int(c) for i, c in enumerate(reversed(digits)))
    return -total % 10


def _script(word: str) -> str:
    return "CYRILLIC" if "Ѐ" <= word[0] <= "ӿ" else "GREEK" if "Ͱ" <= word[0] <= "Ͽ" or "ἀ" <= word[0] <= "῾" else "LATIN"


def _more(key: bytes, tweak: str, value: str, n: int) -> str:
    """n characters, letters and digits in turn."""
    rest, out = _number(key, tweak, "more", value), ""
    for i in range(n):
        own = _CLASSES[1 - i % 2]
        rest, at = divmod(rest, len(own))
        out += own[at]
    return out


def surrogate(key: bytes, kind: str, value: str, attempt: int = 0) -> str:
    """The replacement of a canonical value; another one for each attempt."""
    tweak = f"{kind}{attempt}"
    more = _more(key, tweak, value, attempt - LONGER + 1) if attempt >= LONGER and kind in ("email", "secret") else ""
    if kind == "email":
        local, _, domain = value.rpartition("@")
        top = domain.rindex(".")
        local, _, name = _swap(key, tweak, f"{local}@{domain[:top]}").rpartition("@")
        return f"{local}{more}@{name}{domain[top:]}"
    if kind == "ip":
        octets = list(map(int, value.split(".")))
        private = lambda o: o[0] in (0, 10, 127) or o[0] >= 224 or tuple(o[:2]) in ((192, 168), (169, 254)) or (o[0] == 172 and 16 <= o[1] < 32)
        new = permute(key, tweak, octets, [256] * 4)
        while private(new) != private(octets):  # the permutation, followed until it is back in the range
            new = permute(key, tweak, new, [256] * 4)
        return ".".join(map(str, new))
    if kind == "card":
        valid = int(value[-1]) == _luhn(value[:-1])
        new = _swap(key, f"{tweak}{valid}", value[:-1] if valid else value, {0, 1} if value[0] == "2" or len(value) == 15 else {0})
        return new + str(_luhn(new)) if valid else new
    if kind == "ssn":
        return _swap(key, tweak, value)
    if kind == "phone":
        return _swap(key, tweak, value, set(range(value.find(" ") + 1)))
    if kind == "iban":
        new = _swap(key, tweak, value[4:])
        rest = int("".join(str(int(c, 36)) for c in new + value[:2] + "00"))
        return f"{value[:2]}{98 - rest % 97:02d}{new}"
    if kind == "secret":
        return _swap(key, tweak, value, alphabet="0123456789abcdef" if re.fullmatch(r"[0-9a-f]+", value) else None) + more
    script = _script(value)
    parts, ending = SYLLABLES[script], ENDINGS[script].get(kind, "")
    n, out = _number(key, tweak, value), ""
    for _ in range((3 if ending else 4) + attempt):  # more of them with every attempt
        n, i = divmod(n, len(parts))
        out += parts[i]
    return (out + ending).capitalize()


def _parts(word: str) -> list[tuple[str, int, int]]:
    """(canonical, start, end) of the parts of a word between hyphens and apostrophes; single letters stay."""
    return [(m[0][0].upper() + m[0][1:].lower(), *m.span()) for m in re.finditer(rf"{_LETTER}+", word) if len(m[0]) > 1]


def _tokens(kind: str, found: str):
    """(kind, canonical value, as it stands, how the replacement is written there), pieces of what was found."""
    if kind == "name":
        title = _TITLE.match(found)
        at = title.end() if title else 0
        told = "male" if title and title["title"] in MALE_TITLES else "female" if title and title["title"] in FEMALE_TITLES else "given"
        words = [m for m in re.finditer(rf"{_INITIAL}|{_WORD}", found[at:]) if m[0][-1] != "."]
        for i, m in enumerate(words):
            parts = _parts(m[0])
            known = next((g for w, _, _ in parts for g, names in (("male", MALE), ("female", FEMALE)) if w in names), None)
            own = known or ("family" if i == len(words) - 1 else told)
            for w, a, b in parts:
                yield own, w, at + m.start() + a, at + m.start() + b
    elif kind == "email":
        yield kind, found.lower(), 0, len(found)
    elif kind in ("card", "iban"):
        value = re.sub("[ -]", "", found)
        if kind == "iban" or int(value[-1]) == _luhn(value[:-1]):  # other long numbers are no cards
            yield kind, value, 0, len(found)
    elif kind == "phone":
        code = re.match(r"\+\d{1,3}(?=[ .(-])|\+1|", found)[0]
        yield kind, f"{code} {re.sub(r'[^0-9]', '', found[len(code) :])}", 0, len(found)
    else:
        yield kind, found, 0, len(found)


def _written(kind: str, found: str, new: str) -> str:
    """The replacement with the capitals and separators of what was found."""
    if kind == "email":
        return "".join(c.upper() if o.isupper() else c for o, c in zip(found.ljust(len(new)), new))
    if kind in ("card", "iban"):
        rest = iter(new)
        return "".join(next(rest) if c.isalnum() else c for c in found)
    if kind == "phone":
        code, _, national = new.partition(" ")
        rest = iter(national)
        return code + "".join(next(rest) if c.isdigit() else c for c in found[len(code) :])
    if kind in _NAMES and len(found) > 1 and not found[1:].islower():
        return new.upper() if found.isupper() else new
    return new.lower() if kind in _NAMES and found.islower() else new


def entities(text: str) -> list[tuple[str, str, int, int]]:
    """(kind, canonical value, start, end) of all that is found, in the order of the text."""
    if not text or not _HINT.search(text):
        return []
    found = [(k, v, m.start() + a, m.start() + b) for m in _FIND.finditer(text) for k, v, a, b in _tokens(m.lastgroup, m.group())]
    families = {v for k, v, _, _ in found if k == "family" and len(v) > 2}
    if families:
        families -= {w[0].upper() + w[1:] for w in re.findall(rf"{_LETTER}+", text) if w.islower()}
    if not families:
        return found
    # other mentions: words with a capital that are in no entity
    taken = iter([(a, b) for _, _, a, b in found] + [(len(text) + 1, len(text) + 1)])
    a, b = next(taken)
    more = []
    for m in re.finditer(rf"(?<!\w){_UPPER}{_LETTER}+(?!\w)", text):
        while b <= m.start():
            a, b = next(taken)
        value = m[0][0] + m[0][1:].lower()
        if m.end() <= a and value in families:
            more.append(("family", value, *m.span()))
    return sorted(found + more, key=lambda e: e[2]) if more else found


def replaced(text: str, key: bytes, attempts: dict) -> tuple[str, int]:
    found = entities(text)
    parts, at = [], 0
    for kind, value, a, b in found:
        parts += [text[at:a], _written(kind, text[a:b], surrogate(key, kind, value, attempts.get((kind, value), 0)))]
        at = b
    return "".join([*parts, text[at:]]) if found else text, len(found)


def _values(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    kind = pa.list_(pa.struct([("kind", pa.string()), ("value", pa.string())]))
    try:
        for batch in batches:
            yield pa.array([[{"kind": k, "value": v} for k, v in sorted({e[:2] for e in entities(t)})] for t in batch.to_pylist()], kind)
    finally:
        give_back()


def _new(key: bytes):
    def new(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for kind, value, attempt in batches:
            yield pa.array([surrogate(key, k, v, a) for k, v, a in zip(kind.to_pylist(), value.to_pylist(), attempt.to_pylist())], pa.string())

    return F.arrow_udf(new, "string").asNondeterministic()


def _replace(key: bytes, sent: dict):
    def replace(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        try:
            yield from anew(batches)
        finally:
            give_back()

    def anew(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for texts, own in batches:
            out = []
            for t, more in zip(texts.to_pylist(), own.to_pylist()):
                attempts = sent | {(e["kind"], e["value"]): e["attempt"] for e in more} if more else sent
                new, n = replaced(t, key, attempts) if t is not None else (None, 0)
                out.append({"text": new, "n": n})
            yield pa.array(out, pa.struct([("text", pa.string()), ("n", pa.int32())]))

    return F.arrow_udf(replace, "text string, n int").asNondeterministic()


def attempts(docs: DataFrame, key: bytes = KEY, rounds: int = 20) -> DataFrame:
    """(kind, value, attempt) of the distinct values of docs (text) whose first replacements collide.

    Goes on until no collision is left; ValueError if as many as before are left `rounds` times in succession.
    """
    found = F.arrow_udf(_values, "array<struct<kind string, value string>>")
    values = docs.select(F.explode(found("text")).alias("e")).select("e.kind", "e.value").distinct()
    new = _new(key)
    now = stored(values.withColumn("attempt", F.lit(0)).withColumn("new", new("kind", "value", "attempt")), "surrogates")
    fewest, stuck = None, 0
    while True:
        held = now.withColumn("domain", F.when(F.col("kind").isin(*_NAMES), "name").otherwise(F.col("kind")))
        # a replacement is kept by the value that has had it longest, so that one drawn again gives way
        order = F.struct("attempt", "value", "kind")
        first = held.groupBy("domain", "new").agg(F.count("*").alias("n"), F.min(order).alias("keep"))
        shared = first.filter("n > 1").select("domain", "new", "keep")
        twice = held.join(shared, ["domain", "new"]).filter("value <> keep.value or kind <> keep.kind").select("kind", "value")
        taken = held.select("domain", "kind", "value", "new").join(held.select("domain", F.col("value").alias("new")), ["domain", "new"], "left_semi").select("kind", "value")
        bad = stored(twice.unionAll(taken).distinct(), "collisions")
        left = bad.count()
        if not left:
            break
        stuck = stuck + 1 if fewest is not None and left >= fewest else 0
        fewest = left if fewest is None else min(fewest, left)
        if stuck >= rounds:
            kinds = sorted(r[0] for r in bad.select("kind").distinct().collect())
            raise ValueError(f"{left} values have no replacement of their own: too many of one format ({', '.join(kinds)})")
        again = now.join(bad.withColumn("bad", F.lit(1)), ["kind", "value"], "left").withColumn("attempt", F.col("attempt") + F.coalesce("bad", F.lit(0)))
        fresh = again.filter("bad = 1").select("kind", "value", "attempt").withColumn("new", new("kind", "value", "attempt"))
        now = stored(again.filter("bad is null").select("kind", "value", "attempt", "new").unionAll(fresh.select("kind", "value", "attempt", "new")), "surrogates")
    return now.filter("attempt > 0").select("kind", "value", "attempt")


def with_surrogates(docs: DataFrame, key: bytes = KEY, most_sent: int = 10_000, name: str = "_pii") -> DataFrame:
    """docs (any columns, text) with `name`, a struct of the new text and the number of entities."""
    small_batches(docs.sparkSession)
    redrawn = stored(attempts(docs, key), "redrawn")
    sent = redrawn.limit(most_sent + 1).collect()
    none = F.lit(None).cast("array<struct<kind string, value string, attempt int>>")
    if len(sent) <= most_sent:
        return docs.withColumn(name, _replace(key, {(r.kind, r.value): r.attempt for r in sent})("text", none))
    # a text's exceptions are found by its hash, so that rows need no key
    hash_, own_ = free_names([*docs.columns, name], "_text", "_own")
    hashed = docs.withColumn(hash_, F.sha2("text", 256))
    found = F.arrow_udf(_values, "array<struct<kind string, value string>>")
    own = hashed.select(F.col(hash_), F.explode(found("text")).alias("e")).select(hash_, "e.kind", "e.value").distinct().join(redrawn, ["kind", "value"])
    own = own.groupBy(hash_).agg(F.collect_list(F.struct("kind", "value", "attempt")).alias(own_))
    return hashed.join(own, hash_, "left").withColumn(name, _replace(key, {})("text", F.col(own_))).drop(hash_, own_)


def private_documents(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """docs with personal data replaced; n_chars, if there, is counted anew."""
    (pii,) = free_names(docs.columns, "_pii")
    new = with_surrogates(docs, name=pii)
    text = F.col(f"{pii}.text")
    own = {"text": text.alias("text"), "n_chars": F.when(F.col(f"{pii}.n") > 0, F.length(text)).otherwise(F.col("n_chars")).alias("n_chars") if "n_chars" in docs.columns else None}
    out = new.select(*(own.get(c, F.col(f"`{c}`")) for c in docs.columns))
    return out.select(*(F.col(f"`{f.name}`").cast(f.dataType) for f in docs.schema))


def op8_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return with_surrogates(docs).select("doc_id", F.col("_pii.n").alias("n_entities"), F.col("_pii.text").alias("text"))
