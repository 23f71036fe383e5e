"""Personal data replaced by keyed surrogates of the same type, script, gender and format.

An entity is found by pattern, with check digits where its type has them, and reduced to a
canonical form, so that spellings of one entity share a surrogate. It is drawn from the canonical
form alone and then laid into the spelling. The surrogate comes from an HMAC of type, canonical form and attempt: signs stay, digits become digits, letters become
letters of the same script and case, names become names of the same gender, and check digits
are made right again. Distinct entities of the whole table are then checked: two that fell on
one surrogate, or a surrogate that is itself an entity of the table, get the next attempt
until none collides. Equal entities keep equal surrogates in all documents.
"""

from __future__ import annotations

import hashlib
import hmac
import re
import uuid
from collections.abc import Callable, Iterable, Iterator, Mapping
from functools import cache
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from filelake.session import cut_lineage

# Re-keyed entities are handed to the tasks in a closure up to this number, beyond it by a join.
CLOSURE_ENTITIES = 20_000
# From this round on, one that settles nothing ends the search.
MAX_ROUNDS = 40

# Titles by gender, syllables of invented names, address ranges for tests.
TITLES = {
    "f": ("Mrs", "Ms", "Miss", "Frau", "Señora", "Sra", "Doña", "Mme", "Madame", "Mademoiselle"),
    "m": ("Mr", "Herr", "Señor", "Sr", "Don", "Monsieur"),
    "n": ("Dr", "Prof"),
}
FIRST = {
    "f": ("Anna", "Clara", "Elena", "Greta", "Ines", "Julia", "Laura", "Maria", "Nora", "Olivia", "Paula", "Sofia", "Teresa", "Vera"),
    "m": ("Adam", "Bruno", "Carlos", "David", "Erik", "Felix", "Hugo", "Jonas", "Lukas", "Martin", "Oscar", "Paul", "Simon", "Victor"),
    "n": ("Alex", "Chris", "Dominique", "Kim", "Robin", "Sam", "Sascha", "Toni"),
}
CYRILLIC_FIRST = {"f": ("Анна", "Вера", "Елена", "Ирина", "Мария", "Ольга"), "m": ("Антон", "Борис", "Виктор", "Иван", "Павел", "Сергей"), "n": ("Саша", "Женя")}
SYLLABLES = ("bar", "bel", "dor", "fen", "gal", "har", "kel", "lan", "mar", "nor", "pel", "ros", "sen", "tal", "ver", "wil")
CYRILLIC_SYLLABLES = ("бар", "бел", "дор", "вен", "гал", "кар", "лан", "мар", "нор", "пол", "рос", "сен", "тал", "вер")
# Alphabets a letter is replaced within.
ALPHABETS = (
    "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", "àáâãäåæçèéêëìíîïñòóôõöøùúûüý", "ÀÁÂÃÄÅÆÇÈÉÊËÌÍÎÏÑÒÓÔÕÖØÙÚÛÜÝ",
    "абвгдежзийклмнопрстуфхцчшщъыьэюя", "АБВГДЕЖЗИЙКЛМНОПРСТУФХЦЧШЩЪЫЬЭЮЯ", "αβγδεζηθικλμνξοπρστυφχψω", "ΑΒΓΔΕΖΗΘΙΚΛΜΝΞΟΠΡΣΤΥΦΧΨΩ",
)
_WITHIN = {c: a for a in ALPHABETS for c in a}
# First and last letters of further scripts, each a run without gaps.
SCRIPTS = (("ά", "ώ"), ("א", "ת"), ("ا", "غ"), ("ف", "ي"), ("अ", "ह"), ("ก", "ฮ"), ("ぁ", "ん"), ("ァ", "ン"), ("一", "龥"), ("가", "힣"), ("ა", "ჰ"), ("ա", "ֆ"), ("Ա", "Ֆ"))
_JOINTS = re.compile(r"([-'’])")
_HEX = "0123456789abcdef"
# Calling codes have one, two or three digits, none the start of another.
_COUNTRY = re.compile(r"\+(?:[17]|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|\d{1,3})|")
# What stands before a secret, and marks that its first signs are.
_HEAD = re.compile(r"(?i)(?:[a-z_]*(?:password|passwd|secret|token|api_?key)\s*[=:]\s*[\"']?)?")
_MARK = re.compile(r"(?:(?:AKIA|ghp_|sk-)(?=[A-Za-z0-9]{16}))?")


class _Stream:
    """Numbers drawn from an HMAC, in the same order for the same key and seed."""

    def __init__(self, key: bytes, *seed: str, longer: int = 0):
        # By how much a value of free length is to be longer, so that its forms do not run out.
        self.longer = longer
        self._key, self._seed, self._count, self._bytes = key, "\0".join(seed).encode(), 0, b""

    def below(self, n: int) -> int:
        if len(self._bytes) < 4:
            self._bytes = hmac.new(self._key, self._seed + self._count.to_bytes(4, "big"), hashlib.sha256).digest()
            self._count += 1
        value, self._bytes = int.from_bytes(self._bytes[:4], "big"), self._bytes[4:]
        return value % n


def luhn_ok(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = int(d) * (1 + k % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def iban_ok(compact: str) -> bool:
    return int("".join(str(int(c, 36)) for c in compact[4:] + compact[:4])) % 97 == 1


def _alike(value: str, draw: _Stream) -> str:
    """Every letter and digit replaced within its alphabet; other signs stay."""
    return "".join(_WITHIN[c][draw.below(len(_WITHIN[c]))] if c in _WITHIN else c for c in value)


def _letters(draw: _Stream) -> str:
    return "".join(_HEX[10 + draw.below(6)] for _ in range(draw.longer))


def _digits_in(value: str, digits: str) -> str:
    it = iter(digits)
    return "".join(next(it) if c.isdigit() else c for c in value)


def _digits(value: str) -> str:
    return "".join(c for c in value if c.isdigit())


def _compact(value: str) -> str:
    return re.sub(r"[ -]", "", value).upper()


def _number(value: str) -> str:
    return "+" * value.startswith("+") + _digits(value)


def _address(value: str) -> str:
    return ".".join(str(int(part)) for part in value.split("."))


def _body(value: str) -> str:
    return value[len(_HEAD.match(value)[0]) :]


def _folded(value: str) -> str:
    return value.casefold().replace("’", "'")


def _card(value: str, canonical: str, draw: _Stream) -> str:
    body = canonical[0] + "".join(str(draw.below(10)) for _ in canonical[2:])
    return _digits_in(value, next(body + str(d) for d in range(10) if luhn_ok(body + str(d))))


def _phone(value: str, canonical: str, draw: _Stream) -> str:
    keep = _COUNTRY.match(canonical)[0].removeprefix("+")
    new = [str(draw.below(10)) for _ in _digits(canonical)[len(keep) :]]
    if len(new) >= 10 and new[0] in "01":
        new[0] = str(2 + draw.below(8))
    return _digits_in(value, keep + "".join(new))


def _ssn(value: str, canonical: str, draw: _Stream) -> str:
    return _digits_in(value, f"{1 + draw.below(665):03d}{1 + draw.below(99):02d}{1 + draw.below(9999):04d}")


def _ip(value: str, canonical: str, draw: _Stream) -> str:
    return ".".join(str(1 + draw.below(254)) for _ in range(4))


def _iban(value: str, canonical: str, draw: _Stream) -> str:
    body = _alike(canonical[4:], draw)
    check = 98 - int("".join(str(int(c, 36)) for c in body + canonical[:2] + "00")) % 97
    it = iter(f"{canonical[:2]}{check:02d}{body}")
    return "".join(next(it) if c.isalnum() else c for c in value)


def _email(value: str, canonical: str, draw: _Stream) -> str:
    local, _, domain = canonical.partition("@")
    host, _, top = domain.rpartition(".")
    new = f"{_letters(draw)}{_alike(local, draw)}@{_alike(host, draw)}.{top}"
    return "".join(n.upper() if v.isupper() else n for n, v in zip(new, value[0] * draw.longer + value))


def _secret(value: str, canonical: str, draw: _Stream) -> str:
    mark = _MARK.match(canonical)[0]
    keep, body = _HEAD.match(value)[0] + mark, canonical[len(mark) :]
    if re.fullmatch(r"[0-9a-f]+", body):
        return keep + "".join(_HEX[draw.below(16)] for _ in body) + _letters(draw)
    return keep + _alike(body, draw) + _letters(draw)


def _gender(title: str) -> str:
    title = title.rstrip(".").casefold()
    return next((g for g, titles in TITLES.items() if title in map(str.casefold, titles)), "n")


def _cased(new: str, like: str) -> str:
    """Capitals as in the word that is replaced, where its script has them."""
    if like.isupper() and len(like) > 1:
        return new.upper()
    return new[:1].upper() + new[1:] if like[:1].isupper() else new


def _in_script(word: str, draw: _Stream) -> str:
    """Letters of the scripts of the word's own letters; attempts add more."""
    longer = word + word[-1] * draw.longer
    return "".join(_letter_like(c, draw) for c in longer)


def _letter_like(c: str, draw: _Stream) -> str:
    if c in _WITHIN:
        return _WITHIN[c][draw.below(len(_WITHIN[c]))]
    for first, last in SCRIPTS:
        if first <= c <= last:
            return chr(ord(first) + draw.below(ord(last) - ord(first) + 1))
    return c if not c.isalpha() else chr(ord("a") + draw.below(26))


def _is_latin(word: str) -> bool:
    return all(c < "\u0250" for c in word)


def _is_cyrillic(word: str) -> bool:
    return any("а" <= c <= "я" or c == "ё" for c in word)


def _surname(value: str, canonical: str, draw: _Stream) -> str:
    """An invented surname of the same script, with the hyphens and apostrophes of the name."""
    pieces = _JOINTS.split(canonical)
    longest = max(range(0, len(pieces), 2), key=lambda k: len(pieces[k]))
    out = []
    for k, (piece, like) in enumerate(zip(pieces, _JOINTS.split(value))):
        if k % 2:
            out.append(like)
        elif len(piece) < 3 and k != longest:
            out.append(_cased("".join(_letter_like(c, draw) for c in piece), like))
        elif _is_latin(piece) or _is_cyrillic(piece):
            parts = CYRILLIC_SYLLABLES if _is_cyrillic(piece) else SYLLABLES
            count = 4 + draw.longer if k == longest else 2
            out.append(_cased("".join(parts[draw.below(len(parts))] for _ in range(count)), like))
        else:
            out.append(_cased(_in_script(piece, draw), like))
    return "".join(out)


def _given(value: str, canonical: str, draw: _Stream) -> str:
    """A first name of the same gender and script; attempts make it longer."""
    gender, _, name = canonical.partition(":")
    if not (_is_latin(name) or _is_cyrillic(name)):
        return _in_script(name, draw)
    firsts, parts = (CYRILLIC_FIRST, CYRILLIC_SYLLABLES) if _is_cyrillic(name) else (FIRST, SYLLABLES)
    new = firsts[gender][draw.below(len(firsts[gender]))] + "".join(parts[draw.below(len(parts))] for _ in range(draw.longer))
    return new.upper() if value.isupper() and len(value) > 1 else new


class Kind(NamedTuple):
    name: str
    pattern: str
    canonical: Callable[[str], str]
    make: Callable[[str, str, _Stream], str]
    valid: Callable[[str], bool] = lambda value: True


# A word of a name begins with a letter that is not a small Latin one; hyphens and apostrophes join its parts.
_JOINED = r"(?:[-'’][^\W\d_]{2,})"  # not the one letter of a genitive
_FIRST_WORD = rf"[^\W\d_a-zà-ÿ][^\W\d_]*{_JOINED}*"
_NEXT_WORD = rf"[^\W\d_a-zà-ÿ](?:[^\W\d_]+{_JOINED}*|{_JOINED}+)"
_TITLE = "|".join(t for titles in TITLES.values() for t in titles)
# Earlier kinds win where two meet. The patterns.
KINDS = (
    Kind("EMAIL", r"[A-Za-z0-9](?:[A-Za-z0-9._%+-]{0,63})@(?:[A-Za-z0-9](?:[A-Za-z0-9-]{0,62})\.)+[A-Za-z]{2,24}", str.lower, _email),
    Kind("SECRET", r"(?i:\b[a-z_]{0,32}(?:password|passwd|secret|token|api_?key)\s*[=:]\s*[\"']?(?=[/+_-]*[A-Za-z0-9])[A-Za-z0-9/+_-]{8,}|\bAKIA[A-Z0-9]{16}\b|\bghp_[A-Za-z0-9]{20,}|\bsk-[A-Za-z0-9]{20,})", _body, _secret),
    Kind("IBAN", r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b", _compact, _iban, lambda v: iban_ok(_compact(v))),
    Kind("CARD", r"\b\d(?:[ -]?\d){12,18}\b", _digits, _card, lambda v: luhn_ok(_digits(v))),
    Kind("IP", r"\b(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)\b(?!\.\d)", _address, _ip),
    Kind("SSN", r"\b\d{3}-\d{2}-\d{4}\b", _digits, _ssn),
    Kind("PHONE", r"(?<![\w+])(?:\+\d{1,3}[ .-]?)?(?:\(\d{2,4}\) ?|\b\d{2,4}[ .-])\d{3}[ .-]\d{4}\b", _number, _phone),
    Kind("PHONE", r"(?<![\w+])\+\d{1,3}(?:[ .-]?\d{2,4}){2,4}\b", _number, _phone, lambda v: len(_digits(v)) >= 8),
    Kind("NAME", rf"\b(?:{_TITLE})\.?[ \t]+{_FIRST_WORD}(?:[ \t]+{_NEXT_WORD})?", _folded, _surname),
)
# What a name is made of: each part is replaced by itself, so that one surname is one surrogate wherever it stands.
PARTS = {"SURNAME": Kind("SURNAME", "", _folded, _surname), "GIVEN": Kind("GIVEN", "", _folded, _given)}
# Signs without which a kind cannot occur, so that most texts are passed over at once.
_NEEDS = {
    "EMAIL": re.compile("@"), "SECRET": re.compile("(?i:passw|secret|token|api_?key|AKIA|ghp_|sk-)"), "IBAN": re.compile(r"[A-Z]{2}\d{2}"),
    "CARD": re.compile(r"\d[ -]?\d[ -]?\d[ -]?\d[ -]?\d"), "IP": re.compile(r"\d\.\d"), "SSN": re.compile(r"\d-\d"), "PHONE": re.compile(r"\d[ .-]?\d{3}"),
    "NAME": re.compile(rf"\b(?:{_TITLE})\b"),
}


@cache
def _compiled() -> list[tuple[Kind, re.Pattern]]:
    return [(k, re.compile(k.pattern)) for k in KINDS]


class Part(NamedTuple):
    """What one surrogate is drawn for: an entity, or the first name or surname in one."""

    kind: Kind
    canonical: str
    value: str

    @property
    def slot(self) -> tuple[str, str]:
        return self.kind.name, self.canonical


class Entity(NamedTuple):
    start: int
    end: int
    kind: Kind
    value: str

    def parts(self) -> list[Part]:
        if self.kind.name != "NAME":
            return [Part(self.kind, self.kind.canonical(self.value), self.value)]
        title, *names = self.value.split()
        given = [Part(PARTS["GIVEN"], f"{_gender(title)}:{_folded(n)}", n) for n in names[:-1]]
        return [*given, Part(PARTS["SURNAME"], _folded(names[-1]), names[-1])]


def find_entities(text: str) -> list[Entity]:
    """Entities of the whole text in order, none within another."""
    found: list[Entity] = []
    for kind, pattern in _compiled():
        if _NEEDS[kind.name].search(text):
            for m in pattern.finditer(text):
                if kind.valid(m[0]):
                    found.append(Entity(m.start(), m.end(), kind, m[0]))
    if len(found) < 2:
        return found
    rank = {id(k): n for n, (k, _) in enumerate(_compiled())}
    kept: list[Entity] = []
    for e in sorted(found, key=lambda e: (e.start, rank[id(e.kind)])):
        if kept and e.start < kept[-1].end:
            if rank[id(e.kind)] < rank[id(kept[-1].kind)]:
                kept[-1] = e
            continue
        kept.append(e)
    return kept


def part_surrogate(part: Part, key: bytes, attempt: int = 0) -> str:
    """The surrogate in the part's own spelling; never the part itself."""
    for turn in range(100):
        new = part.kind.make(part.value, part.canonical, _Stream(key, part.kind.name, part.canonical, str(attempt), str(turn), longer=attempt))
        if made_canonical(part, new) != part.canonical:
            return new
    raise ValueError(f"no other value of the form of a {part.kind.name}")


def made_canonical(part: Part, new: str) -> str:
    """The canonical form of a surrogate, to be compared with those of parts."""
    gender = part.canonical.partition(":")[0] + ":" if part.kind.name == "GIVEN" else ""
    return gender + part.kind.canonical(new)


def surrogate(e: Entity, key: bytes, attempts: Mapping[tuple[str, str], int]) -> str:
    """An entity's surrogate: of a name the title stays and every part is replaced."""
    made = [part_surrogate(p, key, attempts.get(p.slot, 0)) for p in e.parts()]
    if e.kind.name != "NAME":
        return made[0]
    words = re.split(r"(\s+)", e.value)
    for k, new in enumerate(made):
        words[2 + 2 * k] = new
    return "".join(words)


_ENTITY = "kind string, canonical string, value string, hits long"


def list_entities(docs: DataFrame) -> DataFrame:
    """Distinct entities of all texts, names by their parts: ``kind, canonical, value`` (its least spelling) and ``hits``."""

    def task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: dict[tuple[str, str], list] = {}
            for text in batch.column("text").to_pylist():
                for part in (p for e in find_entities(text or "") for p in e.parts()):
                    slot = seen.setdefault(part.slot, [part.value, 0])
                    slot[0] = min(slot[0], part.value)
                    slot[1] += 1
            rows = [(k, c, v, n) for (k, c), (v, n) in seen.items()]
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[i] for r in rows], pa.int64() if i == 3 else pa.string()) for i in range(4)], ["kind", "canonical", "value", "hits"]
            )

    found = docs.select("text").where("text is not null").mapInArrow(task, _ENTITY)
    return found.groupBy("kind", "canonical").agg(F.min("value").alias("value"), F.sum("hits").alias("hits"))


def _with_surrogates(entities: DataFrame, key: bytes) -> DataFrame:
    """Add ``made``, the canonical form of the surrogate for ``attempt``."""
    names = ["kind", "canonical", "value", "attempt"]

    def task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_name = {k.name: k for k in reversed(KINDS)} | PARTS
        for batch in batches:
            made = []
            for row in batch.to_pylist():
                part = Part(by_name[row["kind"]], row["canonical"], row["value"])
                made.append(made_canonical(part, part_surrogate(part, key, row["attempt"])))
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(made, pa.string())], [*names, "made"])

    return entities.select(*names).mapInArrow(task, "kind string, canonical string, value string, attempt int, made string")


def resolve_collisions(entities: DataFrame, key: bytes) -> DataFrame:
    """``kind, canonical, attempt`` of the entities that need another attempt than the first.

    A surrogate must differ from that of every other entity of its kind and from every entity.
    Of several on one surrogate the least canonical form keeps it; the others, and those that
    hit an entity, go on. Surrogates held so far stay. Names, addresses and secrets get longer
    with every attempt; only a kind of fixed length can run out of forms.
    """
    named = entities.select("kind", "canonical", "value")
    taken = named.select("kind", F.col("canonical").alias("made"))
    open_rows = named.withColumn("attempt", F.lit(0))
    moved: DataFrame | None = None
    rounds = 0
    while True:
        rounds += 1
        made = cut_lineage(_with_surrogates(open_rows, key))
        # One entity per surrogate keeps it, unless the surrogate is already given out.
        free = made.join(taken, ["kind", "made"], "left_anti")
        keeps = free.groupBy("kind", "made").agg(F.min("canonical").alias("canonical"))
        settled = cut_lineage(made.join(keeps, ["kind", "made", "canonical"]))
        again = settled.where("attempt > 0").select("kind", "canonical", "attempt")
        moved = again if moved is None else moved.unionByName(again)
        open_rows = made.join(settled.select("kind", "canonical"), ["kind", "canonical"], "left_anti")
        open_rows = cut_lineage(open_rows.select("kind", "canonical", "value", (F.col("attempt") + 1).cast("int").alias("attempt")))
        if open_rows.isEmpty():
            return moved
        if rounds >= MAX_ROUNDS and settled.isEmpty():
            raise RuntimeError("surrogates still collide: a kind has more entities than forms")
        taken = cut_lineage(taken.unionByName(settled.select("kind", "made")))


def replace_entities(docs: DataFrame, key: bytes) -> DataFrame:
    """``docs`` with the entities in ``text`` replaced, and ``n_entities`` and ``kinds`` added.

    Other columns pass through; input columns named ``n_entities`` or ``kinds`` give way to the
    result's. NULL and empty texts stay as they are with no entity; repeated rows give repeated
    rows; an empty table gives no row.
    """
    moved = cut_lineage(resolve_collisions(cut_lineage(list_entities(docs)), key))
    few = moved.limit(CLOSURE_ENTITIES + 1).collect()
    names = [c for c in docs.columns if c not in ("n_entities", "kinds")]
    fields = [f for f in docs.schema.fields if f.name in names]
    rows = docs.select(*[F.col(f"`{c}`") for c in names])
    table: dict[tuple[str, str], int] = {}
    own_column = f"moved_{uuid.uuid4().hex}"
    if len(few) <= CLOSURE_ENTITIES:
        table = {(r["kind"], r["canonical"]): r["attempt"] for r in few}
        rows = rows.withColumn(own_column, F.lit(None).cast("array<struct<kind:string,canonical:string,attempt:int>>"))
    else:
        rows = _with_moved(rows, moved, own_column)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)

    def task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, counts, kinds = [], [], []
            for text, own in zip(batch.column("text").to_pylist(), batch.column(own_column).to_pylist()):
                attempts = {(m["kind"], m["canonical"]): m["attempt"] for m in own} if own else table
                found = find_entities(text) if text else []
                if found:
                    parts, at = [], 0
                    for e in found:
                        parts += [text[at : e.start], surrogate(e, key, attempts)]
                        at = e.end
                    text = "".join([*parts, text[at:]])
                texts.append(text)
                counts.append(len(found))
                kinds.append(sorted({e.kind.name for e in found}))
            arrays = [pa.array(texts, pa.string()) if n == "text" else batch.column(n) for n in names]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(counts, pa.int32()), pa.array(kinds, pa.list_(pa.string()))], [*names, "n_entities", "kinds"])

    return rows.mapInArrow(task, f"{schema}, n_entities int, kinds array<string>")


def _with_moved(rows: DataFrame, moved: DataFrame, column: str) -> DataFrame:
    """Rows with the re-keyed entities of their text, joined by a digest of the text."""
    theirs, ours = f"{column}_theirs", f"{column}_ours"

    def task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = zip(batch.column("digest").to_pylist(), batch.column("text").to_pylist())
            found = sorted({(d, *p.slot) for d, t in texts for e in find_entities(t or "") for p in e.parts()})
            yield pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], pa.string()) for i in range(3)], ["digest", "kind", "canonical"])

    digest = F.sha2(F.col("text").cast("binary"), 256)
    uses = rows.select(digest.alias("digest"), "text").mapInArrow(task, "digest string, kind string, canonical string").distinct()
    each = uses.join(moved, ["kind", "canonical"]).groupBy(F.col("digest").alias(theirs))
    each = each.agg(F.collect_list(F.struct("kind", "canonical", "attempt")).alias(column))
    return rows.withColumn(ours, digest).join(each, F.col(ours) == F.col(theirs), "left").drop(ours, theirs)
