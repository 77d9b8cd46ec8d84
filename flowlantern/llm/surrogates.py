"""Personal data replaced by surrogates.

Addresses, telephone, card and account numbers, network addresses, secrets and names with a title are found by patterns. Every entity
has a canonical form (its letters and digits in lower case), from which a keyed hash draws a surrogate of the same kind: letters become
letters of the same script, digits digits, cards stay valid by their check digit, names keep gender and script. A mention gets the
surrogate poured into its own format, so mentions of one entity stay one entity everywhere.

Distinct entities get distinct surrogates, and none that is itself an entity of the corpus: surrogates are grouped by value, and all but
the first of each group draw again until none collide. That ends for every corpus: names and mail addresses grow longer with the draws, and after
``DRAWS`` of them the other kinds, whose length is fixed, take a keyed permutation of all values of their shape, which is distinct by construction; what
is given up then, where a shape is nearly full, is only that a surrogate is no entity of the corpus. Valid card and account numbers stay valid. Names
in scripts without a list of given names become letters of the same script. Only entities that had to draw again are passed to the rewriting step; beyond
``EXCEPTIONS`` of them they are joined to the texts instead of being sent along.

Defined cases: null stays null, empty stays empty; texts without entities stay as they are; the result depends on the key and the set
of entities only, not on partitions. Repeated rows are rewritten alike. Further columns stay; a column of the count's name is replaced.
"""

from __future__ import annotations

import hashlib
import hmac
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowlantern.llm.graph import stored

EXCEPTIONS = 100_000
DRAWS = 8  # hashed draws before a permutation

_TITLES_F = "Mrs|Ms|Miss|Madam|Frau|Madame|Mme|Mlle|Señora|Sra|Doña|Госпожа|Κυρία"
_TITLES_M = "Mr|Sir|Herr|Monsieur|Señor|Sr|Don|Господин|Κύριος"
_NAME = r"[^\W\d_]+(?:[-'’][^\W\d_]+)*"
_KINDS: list[tuple[str, re.Pattern, re.Pattern]] = [(k, re.compile(guard), re.compile(p)) for k, guard, p in (
    ("email", "@", r"(?<![\w.+-])[\w.+-]+@[\w-]+(?:\.[\w-]+)+"),
    ("secret", r"AKIA|[=:]", r"\bAKIA[A-Z0-9]{16}\b|(?i:\b(?:password|passwd|secret|token|api_?key)\s*[=:]\s*[\"']?)(?P<value>[A-Za-z0-9_\-+/]{8,})"),
    ("iban", r"[A-Z]{2}\d\d", r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?\b"),
    ("card", r"\d{4}", r"(?<![\w+-])(?:\d{4}[ -]?){3}\d{1,7}(?![\w-])"),
    # one-digit groups need a separator and another group behind them, so that neither "+100" nor a count after a number is one
    ("phone", r"\+\d|\d{3}", r"(?<![\w.])(?:\+\d{1,3}[ .-]?)?(?:\(\d{2,4}\) ?|\d{3}[ .-])\d{3}[ .-]?\d{4}(?![\w-])|(?<![\w.])\+\d{1,3}(?:(?:[ .-]\d(?=[ .-]\d))*[ .-]?\d{2,4}){2,5}(?![\w-])"),
    ("national", r"\d-\d", r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])"),
    ("ipv4", r"\d\.\d", r"(?<![\w.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\w]|\.\d)"),
    ("woman", _TITLES_F, rf"\b(?:{_TITLES_F})\.? (?P<value>{_NAME}(?: {_NAME})?)"),
    ("man", _TITLES_M, rf"\b(?:{_TITLES_M})\.? (?P<value>{_NAME}(?: {_NAME})?)"),
)]
_NAMED = {"woman", "man"}

# given names by script and gender, and parts from which family names are built
_GIVEN = {
    ("latin", "woman"): "Anna Clara Elena Ida Julia Laura Maria Nora Paula Rosa Sofia Vera".split(),
    ("latin", "man"): "Adam Bruno David Emil Felix Hugo Ivan Jonas Leo Martin Oscar Paul".split(),
    ("cyrillic", "woman"): "Анна Вера Елена Ирина Мария Нина Ольга Софья".split(),
    ("cyrillic", "man"): "Антон Борис Иван Игорь Олег Павел Пётр Юрий".split(),
    ("greek", "woman"): "Άννα Ελένη Ζωή Ιρις Μαρία Νίκη Σοφία Χαρά".split(),
    ("greek", "man"): "Άρης Γιώργος Ηλίας Κώστας Νίκος Πάνος Πέτρος Φώτης".split(),
}
_PARTS = {
    "latin": "bar ben dal den dor fal fen gar hal hen kal ken lan len mar mel nor pel ran ros sal sen tal ten tor val ven wal wen zel".split(),
    "cyrillic": "бар бел вер вол гор дан зел ков лев лук мар мир нов пет ром сав тим фед".split(),
    "greek": "αλε βασ γερ δημ θεο καλ κων λαμ μαν μιχ νικ παπ πετ σταμ χρισ".split(),
}
_LETTERS = {"latin": "abcdefghijklmnopqrstuvwxyz", "cyrillic": "абвгдежзиклмнопрстуфхцчшэюя", "greek": "αβγδεζηθικλμνξοπρστυφχψω"}


# first and last letters of further scripts
_RANGES = [(0x0561, 0x0586), (0x05D0, 0x05EA), (0x0621, 0x064A), (0x0915, 0x0939), (0x0E01, 0x0E2E), (0x10D0, 0x10F0),
           (0x3042, 0x3093), (0x30A2, 0x30F3), (0x4E00, 0x9FA5), (0xAC00, 0xD7A3)]


def _range(c: str) -> tuple[int, int] | None:
    return next(((lo, hi) for lo, hi in _RANGES if lo <= ord(c) <= hi), None) if c > "\u0530" else None


def script(text: str) -> str:
    for c in text:
        if "\u0370" <= c <= "\u03ff":
            return "greek"
        if "\u0400" <= c <= "\u04ff":
            return "cyrillic"
    return "latin"


def entities(text: str) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, canonical form) of the entities of a text, in order and without overlaps; earlier kinds come first."""
    out: list[tuple[int, int, str, str]] = []
    for kind, guard, pattern in _KINDS:
        if not guard.search(text):
            continue
        for m in pattern.finditer(text):
            a, b = m.span("value") if "value" in pattern.groupindex and m.group("value") else m.span()
            if kind in _NAMED:
                words = m.group("value").split(" ")
                if not words[0][:1].isupper():
                    continue
                if len(words) == 2 and not words[1][:1].isupper():
                    b = a + len(words[0])
            if any(a < y and x < b for x, y, _, _ in out):
                continue
            raw = text[a:b]
            if kind == "ipv4":
                canon = raw
            elif kind in _NAMED:
                canon = " ".join(raw.lower().split())
            elif kind == "secret":
                canon = raw
            else:
                canon = "".join(c for c in raw.lower() if c.isalnum() or (kind == "email" and c in "@.-_+"))
            out.append((a, b, kind, canon))
    return sorted(out)


class _Draw:
    """A stream of numbers from the key, the entity and the attempt."""

    def __init__(self, key: bytes, *what):
        self.key, self.what, self.block, self.pool, self.left = key, "\x1f".join(map(str, what)).encode(), 0, 0, 0

    def below(self, n: int) -> int:
        if self.left < 1 << 40:
            d = hmac.new(self.key, self.what + self.block.to_bytes(4, "big"), hashlib.sha256).digest()
            self.pool, self.left, self.block = int.from_bytes(d, "big"), 1 << 256, self.block + 1
        v = self.pool % n
        self.pool //= n
        self.left //= n
        return v


def _luhn(digits: str) -> int:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + (i % 2 == 0))
        total += d - 9 * (d > 9)
    return -total % 10


def _iban_check(s: str) -> str:
    """The two check digits of an account number in lower case."""
    return f"{98 - int(''.join(str(int(c, 36)) for c in s[4:] + s[:2] + '00')) % 97:02d}"


def _is_iban(s: str) -> bool:
    return s.isascii() and s.isalnum() and len(s) > 4 and s[2:4] == _iban_check(s)


def _public(octets: list[int]) -> bool:
    a, b = octets[:2]
    return not (a in (0, 10, 127) or a > 223 or (a == 192 and b == 168) or (a == 172 and 16 <= b < 32))


def _permute(key: bytes, what: bytes, n: int, v: int) -> int:
    """A keyed bijection of 0..n-1: a Feistel network on the next even number of bits, walked until the value is in range."""
    half = max(1, ((n - 1).bit_length() + 1) // 2)
    mask = (1 << half) - 1
    while True:
        a, b = v >> half, v & mask
        for r in range(6):
            d = hmac.new(key, what + bytes([r]) + b.to_bytes((half + 7) // 8, "big"), hashlib.sha256).digest()
            a, b = b, a ^ (int.from_bytes(d, "big") & mask)
        v = a << half | b
        if v < n:
            return v


def permuted(key: bytes, kind: str, canon: str) -> str:
    """Surrogate of an entity of fixed shape under a bijection of that shape; validity and reach (public, private) stay."""
    if kind == "ipv4":
        o = canon.split(".")
        kept = 1 if o[0] == "10" else 2 if o[:2] == ["192", "168"] or (o[0] == "172" and 16 <= int(o[1]) < 32) else 0
        places = [(int(x), None if i < kept else range(256)) for i, x in enumerate(o)]
        join, alike = lambda x: ".".join(map(str, x)), lambda x: _public([int(v) for v in x])
    else:
        keep = {"secret": 4 if canon.startswith("AKIA") else 0, "iban": 2, "phone": 1, "card": 1}.get(kind, 0)
        places = []
        for i, c in enumerate(canon):
            letters = "0123456789" if c in "0123456789" else _LETTERS[script(c)] if c.isalpha() else ""
            letters = letters.upper() if c.isupper() else letters
            places.append((c, None if i < keep or c not in letters else letters))
        join = "".join
        alike = {"card": lambda x: _luhn(join(x)[:-1]) == int(x[-1]), "iban": lambda x: _is_iban(join(x))}.get(kind, lambda x: True)
    n, v, shape = 1, 0, [kind]
    for c, letters in places:
        shape.append(str(c) if letters is None else f"[{len(letters)}{letters[0]}]")
        if letters is not None:
            v, n = v * len(letters) + letters.index(c), n * len(letters)
    what, own = "\x1f".join(shape).encode(), alike([c for c, _ in places])
    while True:
        v = _permute(key, what, n, v)
        rest, new = v, []
        for c, letters in reversed(places):
            new.append(c if letters is None else letters[rest % len(letters)])
            rest //= 1 if letters is None else len(letters)
        new.reverse()
        if alike(new) == own:
            return join(new)


def _longer(kind: str) -> bool:
    """Kinds whose surrogates may grow."""
    return kind in _NAMED or kind == "email"


def surrogate(key: bytes, kind: str, canon: str, attempt: int = 0) -> str:
    """The canonical form of the surrogate."""
    if attempt >= DRAWS and not _longer(kind):
        return permuted(key, kind, canon)
    r = _Draw(key, "name" if kind in _NAMED else kind, canon, attempt)
    if kind in _NAMED:
        s = script(canon)
        parts = _PARTS[s]
        out = []
        words = canon.split(" ")
        for i, word in enumerate(words):
            foreign = [x for x in map(_range, word) if x]
            if foreign:
                foreign += [foreign[-1]] * (attempt // 4)
                out.append("".join(chr(lo + r.below(hi - lo + 1)) for lo, hi in foreign))
            elif i == 0 and len(words) > 1:
                given = _GIVEN[s, kind]
                out.append(given[r.below(len(given))].lower())
            else:
                out.append("".join(parts[r.below(len(parts))] for _ in range(3 + attempt // 4)))
        return " ".join(out)
    if kind == "ipv4":
        o = canon.split(".")
        kept = 1 if o[0] == "10" else 2 if o[:2] == ["192", "168"] or (o[0] == "172" and 16 <= int(o[1]) < 32) else 0
        new = [str(1 + r.below(254)) for _ in o]
        while kept == 0 and (new[0] in ("10", "127") or new[0] in ("172", "192") or int(new[0]) > 223):
            new[0] = str(1 + r.below(223))
        return ".".join(o[:kept] + new[kept:])
    keep = {"secret": 4 if canon.startswith("AKIA") else 0, "iban": 2}.get(kind, 0)
    hexa = kind == "secret" and re.fullmatch("[0-9a-f]+", canon) is not None
    out = []
    top = canon.rfind(".") if kind == "email" else -1
    for i, c in enumerate(canon):
        if i < keep or not c.isalnum() or (0 <= top < i):
            out.append(c)
        elif hexa:
            out.append("0123456789abcdef"[r.below(16)])
        elif c.isdigit():
            first = kind in ("phone", "card") and i == 0
            out.append(c if first else str(r.below(10)))
        else:
            letters = _LETTERS[script(c)]
            x = letters[r.below(len(letters))]
            out.append(x.upper() if c.isupper() else x)
    if kind == "card" and _luhn(canon[:-1]) == int(canon[-1]):
        out[-1] = str(_luhn("".join(out[:-1])))
    if kind == "iban" and _is_iban(canon):
        out[2:4] = _iban_check("".join(out))
    if kind == "email":
        at = canon.index("@")
        letters = _LETTERS[script(canon[:at])]
        out[at:at] = [letters[r.below(len(letters))] for _ in range(attempt // 4)]
    return "".join(out)


def render(mention: str, kind: str, new: str) -> str:
    """The surrogate in the format of the mention."""
    if kind in ("ipv4", "secret"):
        return new
    if kind in _NAMED:
        pairs = zip(mention.split(" "), new.split(" "))
        return " ".join(w.upper() if m.isupper() and len(m) > 1 else w[:1].upper() + w[1:] for m, w in pairs)
    if kind == "email":
        at, more = mention.index("@"), len(new) - len(mention)
        return "".join(n.upper() if m.isupper() else n for m, n in zip(mention[:at] + "x" * more + mention[at:], new))
    it = iter(new)
    return "".join((lambda n: n.upper() if c.isupper() else n)(next(it)) if c.isalnum() else c for c in mention)


def _group(kind: str) -> str:
    """Kinds between which surrogates must differ, too."""
    return "name" if kind in _NAMED else kind


def _found(docs: DataFrame, text: str) -> DataFrame:
    def run(batches):
        for batch in batches:
            rows = {(k, c) for t in batch.column(0).to_pylist() if t for _, _, k, c in entities(t)}
            rows = sorted(rows)
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.string())], names=["kind", "canon"])

    return docs.select(text).mapInArrow(run, "kind string, canon string").distinct()


def exceptions(docs: DataFrame, key: bytes, text: str = "text") -> DataFrame:
    """(kind, canon, attempt) of the entities whose first surrogate collides."""
    def draw(batches):
        for batch in batches:
            k, c, a = (x.to_pylist() for x in batch.columns)
            new = [surrogate(key, *row) for row in zip(k, c, a)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([_group(x) for x in k], pa.string()), pa.array(new, pa.string())], names=["kind", "canon", "attempt", "grp", "new"])

    rows = stored(_found(docs, text).withColumn("attempt", F.lit(0)), "entities")
    known = rows.select(F.when(F.col("kind").isin(*_NAMED), "name").otherwise(F.col("kind")).alias("grp"), F.col("canon").alias("new")).distinct()
    while True:
        drawn = stored(rows.mapInArrow(draw, "kind string, canon string, attempt int, grp string, new string"), "drawn")
        # the first of a group keeps its surrogate: the one that has drawn most often, then the smallest
        first = drawn.groupBy("grp", "new").agg(F.count("*").alias("n"), F.max(F.struct("attempt", "canon", "kind")).alias("keep"))
        # permuted values of one shape never meet; the second bound is for equal values of two shapes, which only long secrets could have
        may = F.col("kind").isin(*_NAMED, "email")
        bad = (first.where("n > 1").join(drawn, ["grp", "new"]).where("struct(attempt, canon, kind) <> keep")
               .where(may | (F.col("attempt") < 3 * DRAWS)).select("kind", "canon")
               .union(drawn.where(may | (F.col("attempt") < DRAWS)).join(known, ["grp", "new"], "left_semi").select("kind", "canon")).distinct())
        bad = stored(bad.withColumn("again", F.lit(1)), "again")
        if not bad.limit(1).count():
            return rows.where("attempt > 0")
        rows = stored(rows.join(bad, ["kind", "canon"], "left").select("kind", "canon", (F.col("attempt") + F.coalesce("again", F.lit(0))).alias("attempt")), "entities")


def rewrite(text: str | None, key: bytes, attempts: dict[tuple[str, str], int]) -> tuple[str | None, int]:
    if not text:
        return text, 0
    out, last, found = [], 0, entities(text)
    for a, b, kind, canon in found:
        out += [text[last:a], render(text[a:b], kind, surrogate(key, kind, canon, attempts.get((kind, canon), 0)))]
        last = b
    return "".join([*out, text[last:]]), len(found)


def replaced(docs: DataFrame, key: bytes, count: str = "n_entities", text: str = "text") -> DataFrame:
    """The documents with surrogates in ``text``, and ``count``, the number of mentions replaced."""
    docs = docs.drop(count)
    schema = T.StructType([*docs.schema.fields, T.StructField(count, T.IntegerType())])
    ex = stored(exceptions(docs, key, text), "exceptions")
    few = ex.limit(EXCEPTIONS + 1).count() <= EXCEPTIONS
    sent = {(r["kind"], r["canon"]): r["attempt"] for r in ex.collect()} if few else {}

    def run(batches):
        for batch in batches:
            at = batch.schema.get_field_index(text)
            extra = None if few else batch.column(batch.num_columns - 1).to_pylist()
            new = []
            for i, t in enumerate(batch.column(at).to_pylist()):
                own = sent if few else {(x["kind"], x["canon"]): x["attempt"] for x in extra[i] or ()}
                new.append(rewrite(t, key, own))
            columns = list(batch.columns if few else batch.columns[:-1])
            columns[at] = pa.array([t for t, _ in new], pa.string())
            yield pa.RecordBatch.from_arrays([*columns, pa.array([n for _, n in new], pa.int32())], names=schema.names)

    if few:
        return docs.mapInArrow(run, schema)

    def per_text(batches):
        for batch in batches:
            rows = [(h, k, c) for h, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) if t for k, c in {(k, c) for _, _, k, c in entities(t)}]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate((pa.int64(), pa.string(), pa.string()))], names=["h", "kind", "canon"])

    keyed = docs.select(F.xxhash64(text).alias("h"), text).mapInArrow(per_text, "h long, kind string, canon string").distinct()
    lists = keyed.join(ex, ["kind", "canon"]).groupBy("h").agg(F.collect_list(F.struct("kind", "canon", "attempt")).alias("_attempts"))
    joined = docs.join(lists, F.xxhash64(docs[text]) == lists["h"], "left").drop("h")
    return joined.mapInArrow(run, schema)
