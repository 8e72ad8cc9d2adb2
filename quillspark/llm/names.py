"""Problem 4: variant spellings of the names of people and organisations.

Spellings are parsed into tokens (accents, case and marks folded away). A symmetric-delete neighbourhood index on tokens finds
the tokens within one edit or swap of each other: every token is filed under itself and under each of its forms with one
letter deleted, and tokens that meet under a form are compared exactly. A form of n letters is that of at most 26 (n + 1) + 1
folded tokens, so no form is hot.

The spellings of one surname are aligned with each other: the cheapest one-to-one assignment of their tokens, permitting initials,
nicknames and reordered parts, decides. A spelling with full given names is a form of a person; full forms that agree are one
person. A spelling with initials only belongs to a person if it fits exactly one of those with its surname.

A surname that may be a misspelling of another one (see misspelled) is a guest there: its spellings are aligned with the persons
of the other surname, and its persons follow the one they fit best, link by link until a surname is reached that is no
misspelling. Two surnames that both are in use stay apart, whatever their letters. Organisations are told apart by their proper
name.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.session import cut_lineage, load

#: Short forms of given names (fixed values): the first of a group is the full name; a short form may belong to several.
NICKNAMES = (
    "alexander alex sasha xander", "anthony tony", "arthur art", "barbara barb", "beatriz bea", "benjamin ben benny", "catherine cathy", "charles charlie chuck",
    "christopher chris kit", "daniel dan danny", "dmitri dima mitya", "dorothea dora thea dot", "edward ed eddie ted", "ekaterina katya", "elizabeth liz beth betty eliza lizzie",
    "francis frank", "francisco paco pancho", "friedrich fritz", "gabriella gabi gabby", "giuseppe beppe peppe", "gregory greg", "henry harry hank", "ingeborg inge", "isidora isa dora",
    "james jim jimmy", "jennifer jen jenny", "johannes hannes hans", "john jack johnny", "joseph joe", "katherine kate kathy katie", "kenneth ken", "leonardo leo",
    "lorenzo renzo", "margaret peggy maggie meg", "matthew matt", "matthias matti matze", "michael mike mick", "nicholas nick nico", "olivera oli", "patricia pat trish", "penelope penny nell",
    "peter pete", "philip phil", "quentin quin", "rebecca becky becca", "richard dick rick", "robert bob bobby rob", "samantha sam", "samuel sam sammy", "stephen steve", "susannah sue susan",
    "theodore theo ted teddy", "thomas tom tommy", "ursula uschi", "victoria vicky", "vladimir vova volodya", "wilhelmina mina willa", "william bill billy will",
    "yevgenia zhenya", "zacharias zach zack",
)
FULL: dict[str, frozenset[str]] = {n: frozenset(g.split()[0] for g in NICKNAMES if n in g.split()) for group in NICKNAMES for n in group.split()}
#: Kinds of bodies, by their names (fixed values), and words that carry no meaning in the names of organisations.
BODIES = "agency association board bureau center centre college committee commission consortium council department division faculty foundation group institute institution laboratory laboratories network office organisation organization panel programme program project school section society taskforce team union unit university working".split()
STOP = frozenset("the of for f in and at on a an de der die und".split())
TWO_LETTERS = {"ä": "ae", "ö": "oe", "ü": "ue", "ß": "ss", "ø": "o", "æ": "ae", "å": "a", "đ": "d", "ł": "l", "þ": "th", "ð": "d"}


@lru_cache(maxsize=65536)
def fold(token: str) -> str:
    """Small letters without accents; letters that decompose into none are spelled out."""
    t = unicodedata.normalize("NFKC", token).lower()
    t = "".join(TWO_LETTERS[c] if c in "ßøæåđłþð" else c for c in t)
    return re.sub("[^a-z]+", "", "".join(c for c in unicodedata.normalize("NFKD", t) if not unicodedata.combining(c)))


@lru_cache(maxsize=65536)
def spelled_out(token: str) -> str:
    """As fold, with umlauts as two letters."""
    t = unicodedata.normalize("NFKC", token).lower()
    return fold("".join(TWO_LETTERS.get(c, c) for c in t))


@lru_cache(maxsize=65536)
def is_body(word: str) -> bool:
    """Whether a word names a kind of body, in full or cut short: its beginning, or first, last and some letters in order."""
    w = word.lower().rstrip(".")
    if w in BODIES:
        return True
    if not word.endswith(".") or len(w) < 3:
        return False
    inner = re.compile(".*".join(map(re.escape, w)))
    return any(b.startswith(w) or inner.fullmatch(b) for b in BODIES)


def is_organisation(last: str, first: str) -> bool:
    words = re.findall(r"[\w.]+", last + " " + first)
    return any(map(is_body, words)) or (len(words) > 3 and any(w.lower() in ("for", "of", "f", "f.") for w in words))


def initials_of(word: str) -> list[str] | None:
    """Letters of a token that stands for initials ('J.', 'J.-D.', 'RD'); None for a name."""
    letters = re.findall("[^\\W\\d_]", word)
    if len(letters) == 1 or ("." in word and len(letters) <= 3) or (len(letters) <= 2 and word.isupper()):
        return [fold(x) for x in letters]
    return None


def person(last: str, first: str) -> tuple[list[str], list[str], list[str]] | None:
    """Name tokens of the last and the first field, and initials; None without a name."""
    def parts(text: str) -> tuple[list[str], list[str]]:
        names, initials = [], []
        for raw in re.split(r"[\s,{}()]+", text):
            if not any(c.isalpha() for c in raw):
                continue
            letters = initials_of(raw)
            if letters is not None:
                initials += letters
            else:
                names.append(unicodedata.normalize("NFKC", raw).lower())
        return names, initials

    a, ai = parts(last)
    b, bi = parts(first)
    return (a, b, ai + bi) if a or b else None


def within_one(a: str, b: str) -> bool:
    """At most one insertion, deletion, substitution or swap of neighbours apart."""
    if a == b:
        return True
    if abs(len(a) - len(b)) > 1:
        return False
    n = 0
    while n < min(len(a), len(b)) and a[n] == b[n]:
        n += 1
    x, y = a[n:], b[n:]
    return x[1:] == y or x == y[1:] or x[1:] == y[1:] or (len(x) > 1 and len(y) > 1 and x[0] == y[1] and x[1] == y[0] and x[2:] == y[2:])


def deletes(token: str) -> list[str]:
    """The token and its forms with one letter less: the symmetric-delete neighbourhood."""
    return sorted({token, *(token[:i] + token[i + 1 :] for i in range(len(token)))}) if len(token) > 3 else [token]


def same_token(a: str, b: str) -> bool:
    return within_one(fold(a), fold(b)) or spelled_out(a) == fold(b) or fold(a) == spelled_out(b) or within_one(spelled_out(a), spelled_out(b))


@lru_cache(maxsize=65536)
def full_names(token: str) -> frozenset[str]:
    """Full given names that a given name may stand for: itself, or those of its short form."""
    t = fold(token)
    return FULL.get(t) or frozenset((t,))


def shortened(a: str, b: str) -> bool:
    """Whether one name is a beginning of the other, perhaps with an ending of its own: dan and danny of daniel, charlie of charles."""
    a, b = sorted((a, b), key=len)
    m = re.fullmatch(r"(.{2,}(.))\2(?:ie|y|i)|(.{4,})(?:ie|y|i)", a)
    return len(a) > 2 and b.startswith(a) or bool(m) and b.startswith(m.group(1) or m.group(3))


def same_given(a: str, b: str) -> bool:
    if full_names(a) & full_names(b):
        return True
    x, y = fold(a), fold(b)
    if any(shortened(p, q) for p in {x, *full_names(a)} for q in {y, *full_names(b)}):
        return True
    return min(len(x), len(y)) > 3 and same_token(a, b) and not (x in FULL and y in FULL)


def starts_with(name: str, letter: str) -> bool:
    return letter == fold(name)[:1] or any(n.startswith(letter) for n in full_names(name))


PARSED = "name string, kind string, surname string, given array<string>, initials array<string>"


def parse(last: str, first: str) -> list[tuple[str, str, list[str], list[str]]]:
    """Readings of a spelling: (kind, surname or proper name, given names or other words, initials).

    A person's surname is the last field, or, where the parts may be reordered, the first one: both are readings. In braces or
    with the comma inside a field the order is told.
    """
    last, first = last or "", first or ""
    if is_organisation(last, first):
        words = re.findall(r"[^\W\d_]+\.?", re.sub(r"\([A-Z]{2,}\)|[{}]", " ", f"{first} {last}"))
        return [("organisation", "", [w for w in words if not w.endswith(".") and w.lower() not in STOP and not is_body(w)], [])]
    p = person(last, first)
    if p is None:
        return []
    a, b, initials = p
    if not b and len(a) >= 2 and not initials:  # all in one field
        if "," in last:
            return [("person", a[0], a[1:], [])]
        return [("person", a[-1], a[:-1], [])]
    if not a or not b:
        names = a or b
        return [("person", names[-1] if len(names) > 1 else names[0], names[:-1], initials)]
    if first.rstrip().endswith(","):  # the splitter took the surname with its comma for the given name
        return [("person", b[-1], a + b[:-1], initials)]
    if last.rstrip().endswith(","):
        return [("person", a[-1], b + a[:-1], initials)]
    return [("person", a[-1], a[:-1] + b, initials), ("swapped", b[-1], a + b[:-1], initials)]


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = [(f"{last or ''}|{first or ''}", *r) for last, first in zip(b.column("last").to_pylist(), b.column("first").to_pylist(), strict=True) for r in parse(last, first)]
        if rows:
            n, k, s, g, i = zip(*rows, strict=True)
            strings = pa.list_(pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(n, pa.string()), pa.array(k, pa.string()), pa.array(s, pa.string()), pa.array(g, strings), pa.array(i, strings)], names=["name", "kind", "surname", "given", "initials"])


#: A token in at most FEW_FORMS different spellings, or in 1 / MANY of those of its neighbour, may be a misspelling of it...
FEW_FORMS, MANY = 2, 10
#: ...if it has LONG letters (two names of that length hardly come so close by chance), occurs at most FEW_USES times, or if the
#: neighbour has RATIO times its uses or spellings.
LONG, FEW_USES, RATIO = 8, 2, 2


def misspelled(token: Column, n: Column, forms: Column, other_n: Column, other_forms: Column) -> Column:
    """Whether a token may be a misspelling of a neighbour with more uses; n: uses, forms: different spellings that hold it."""
    rare = (forms <= FEW_FORMS) | (other_forms >= MANY * forms)
    return rare & ((F.length(token) >= LONG) | (n <= FEW_USES) | (other_n >= RATIO * n) | (other_forms >= RATIO * forms))


def token_neighbours(tokens: DataFrame) -> DataFrame:
    """(token, other): each folded token, and the tokens with more uses that it may be another writing of.

    tokens: token (folded), alts (its spelled-out forms), n, forms. Writings that differ in accents or umlauts only are always
    neighbours; others must be within one edit and misspelled. No form has more tokens than the alphabet allows.
    """
    filed = tokens.select("token", F.explode(F.array_distinct(F.flatten(F.transform(F.array_union(F.array("token"), "alts"), _deletes)))).alias("form"))
    pairs = filed.alias("a").join(filed.alias("b"), F.expr("a.form = b.form and a.token <> b.token")).select(F.col("a.token").alias("token"), F.col("b.token").alias("other")).distinct()
    a = tokens.select("token", "alts", "n", "forms")
    b = tokens.select(F.col("token").alias("other"), F.col("alts").alias("other_alts"), F.col("n").alias("other_n"), F.col("forms").alias("other_forms"))
    met = pairs.join(a, "token").join(b, "other").where("other_n > n or (other_n = n and other > token)")
    same = F.arrays_overlap(F.array_union("alts", F.array("token")), F.array_union("other_alts", F.array("other")))
    near = F.udf(lambda x, y, p, q: any(within_one(s, t) for s in {x, *p} for t in {y, *q}), "boolean", useArrow=True)
    met = met.where(same | (misspelled(F.col("token"), F.col("n"), F.col("forms"), F.col("other_n"), F.col("other_forms")) & near("token", "other", "alts", "other_alts")))
    return met.select("token", "other", "n", "other_n")


def _deletes(token: Column) -> Column:
    """The forms of deletes() as an expression."""
    one_less = F.transform(F.sequence(F.lit(1), F.length(token)), lambda i: F.concat(F.substring(token, F.lit(1), i - 1), F.substring(token, i + 1, F.length(token))))
    return F.when(F.length(token) > 3, F.concat(F.array(token), one_less)).otherwise(F.array(token))


def resolve(links: DataFrame) -> DataFrame:
    """(child, root) of links (child, parent), one parent a child and no circle: pointers are doubled until none moves."""
    links = cut_lineage(links.select("child", "parent"), "links")
    while True:
        up = links.select(F.col("child").alias("parent"), F.col("parent").alias("next"))
        longer = cut_lineage(links.join(up, "parent", "left").select("child", F.coalesce("next", "parent").alias("parent"), F.col("next").isNotNull().alias("moved")), "links")
        links = longer.select("child", "parent")
        if longer.where("moved").isEmpty():
            return links.withColumnRenamed("parent", "root")


# ---------------------------------------------------------------- entities of one surname


def assign(given_a: list[str], initials_a: list[str], given_b: list[str], initials_b: list[str]) -> int | None:
    """Cost of the cheapest one-to-one alignment of the given-name parts of two spellings; None if they contradict.

    Equal or nicknamed names cost 0, one edit 1, an initial for a name 1, a part without partner (a middle name) 2.
    """
    a = [(x, False) for x in given_a] + [(x, True) for x in initials_a]
    b = [(x, False) for x in given_b] + [(x, True) for x in initials_b]
    if len(a) > len(b):
        a, b = b, a

    def cost(x: tuple[str, bool], y: tuple[str, bool]) -> int | None:
        if x[1] and y[1]:
            return 0 if x[0] == y[0] else None
        if x[1] or y[1]:
            letter, name = (x[0], y[0]) if x[1] else (y[0], x[0])
            return 1 if starts_with(name, letter) else None
        if full_names(x[0]) & full_names(y[0]):
            return 0
        return 1 if same_given(x[0], y[0]) else None

    # the leading parts must agree: a middle name alone is no evidence
    if not a or cost(a[0], b[0]) is None:
        return None
    table = [[FORBIDDEN if (c := cost(x, y)) is None else c + (i != j) for j, y in enumerate(b)] for i, x in enumerate(a)]
    total = cheapest(table)
    return total + 2 * (len(b) - len(a)) if total < FORBIDDEN else None


#: Cost of a pair of parts that contradict, more than any alignment without one.
FORBIDDEN = 1 << 20


def cheapest(table: list[list[int]]) -> int:
    """Least total of one column a row, no column twice (Hungarian method); not more rows than columns."""
    n, m = len(table), len(table[0])
    u, v, row_of, way = [0] * (n + 1), [0] * (m + 1), [0] * (m + 1), [0] * (m + 1)
    for i in range(1, n + 1):
        row_of[0], j = i, 0
        slack, used = [1 << 40] * (m + 1), [False] * (m + 1)
        while row_of[j]:
            used[j] = True
            delta, to = 1 << 40, 0
            for k in range(1, m + 1):
                if not used[k]:
                    if (c := table[row_of[j] - 1][k - 1] - u[row_of[j]] - v[k]) < slack[k]:
                        slack[k], way[k] = c, j
                    if slack[k] < delta:
                        delta, to = slack[k], k
            for k in range(m + 1):
                if used[k]:
                    u[row_of[k]] += delta
                    v[k] -= delta
                else:
                    slack[k] -= delta
            j = to
        while j:
            row_of[j], j = row_of[way[j]], way[j]
    return sum(table[row_of[k] - 1][k - 1] for k in range(1, m + 1) if row_of[k])


def entities(rows: list[tuple[str, list[str], list[str], int]], guests: list[tuple[str, list[str], list[str], int]] = ()) -> list[tuple[str, int]]:
    """Entity number of each spelling of one surname; rows: (name, given, initials, how often).

    guests are spellings of surnames that may be misspellings of this one: each that fits gets the number it fits best, too.

    Spellings with a given name come first, the most frequent ones leading; each joins the leader that it aligns with best, which
    takes over its parts if they are more. Spellings with initials only then join the one leader with which most of their initials
    agree; if several do, none. Those that fit no leader are grouped among themselves in the same way, the longest ones leading.
    """
    full = sorted((r for r in rows if r[1]), key=lambda r: (-r[3], r[0]))
    leaders: list[tuple[list[str], list[str]]] = []
    near: dict[str, set[int]] = {}  # leaders by the forms of their given name: a spelling meets only those it may align with
    out: list[tuple[str, int]] = []

    def fit(given: list[str], initials: list[str]) -> int | None:
        forms = {f for g in given for n in (*full_names(g), fold(g), spelled_out(g)) for f in deletes(n)} | {"." + i for i in initials}
        met = sorted({k for f in forms for k in near.get(f, ())})
        return min(((c, k) for k in met if (c := assign(given, initials, *leaders[k])) is not None), default=(0, None))[1]

    for name, given, initials, _ in full:
        k = fit(given, initials)
        if k is None:
            k = len(leaders)
            leaders.append(([], []))
        if len(given) + len(initials) > sum(map(len, leaders[k])):
            leaders[k], g = (given, initials), given[0]
            for n in (*full_names(g), fold(g), spelled_out(g)):
                for f in (*deletes(n), "." + n[:1]):
                    near.setdefault(f, set()).add(k)
        out.append((name, k))
    by_letter: dict[str, set[int]] = {}
    for k, (g, _) in enumerate(leaders):
        for letter in {fold(g[0])[:1], *(n[:1] for n in full_names(g[0]))}:
            by_letter.setdefault(letter, set()).add(k)

    def fitting(initials: list[str], index: dict[str, set[int]]) -> list[int]:
        """Leaders that the initials fit, of those the ones with most parts that agree."""
        fits = [(min(len(initials), sum(map(len, leaders[k]))), k) for k in sorted(index.get(initials[0], ())) if assign([], initials, *leaders[k]) is not None]
        return [k for n, k in fits if n == max(fits)[0]]

    told: dict[tuple[str, ...], list[int]] = {}  # spellings with the same initials fit the same leaders
    alone: dict[str, set[int]] = {}
    for initials in sorted({tuple(r[2]) for r in rows if not r[1] and r[2]}, key=lambda i: (-len(i), i)):
        fits = fitting([*initials], by_letter) or fitting([*initials], alone)
        if not fits:
            fits = [len(leaders)]
            leaders.append(([], [*initials]))
            alone.setdefault(initials[0], set()).add(fits[0])
        told[initials] = fits
    for name, given, initials, _ in rows:
        if not given and initials and len(told[tuple(initials)]) == 1:
            out.append((name, told[tuple(initials)][0]))
    for name, given, initials, _ in guests:
        fits = [fit(given, initials)] if given else (fitting([*initials], by_letter) or fitting([*initials], alone)) if initials else []
        if len(fits) == 1 and fits[0] is not None:
            out.append((name, fits[0]))
    return out


#: Spellings of an entity that one task pairs with all others of it.
PAIR_ROWS = 1_000
ENTITY = "form string, home string, surname string, number int"


def _entities(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Entities of the surnames of a partition; rows come in order of surname, so one surname is held at a time."""
    held: tuple[list, list] = ([], [])
    homes: dict[str, str] = {}
    now: str | None = None
    out: list[tuple[str, str, str, int]] = []

    def done() -> None:
        out.extend((form, homes[form], now, k) for form, k in entities(*held))

    def batch() -> pa.RecordBatch:
        form, home, surname, number = zip(*out, strict=True)
        out.clear()
        return pa.RecordBatch.from_arrays([pa.array(form, pa.string()), pa.array(home, pa.string()), pa.array(surname, pa.string()), pa.array(number, pa.int32())], names=["form", "home", "surname", "number"])

    for b in batches:
        for surname, home, form, given, initials, n in zip(*(b.column(c).to_pylist() for c in ("surname", "home", "form", "given", "initials", "n")), strict=True):
            if surname != now:
                done()
                now, held, homes = surname, ([], []), {}
            homes[form] = home
            held[home != surname].append((form, given or [], initials or [], n))
        if len(out) >= 10_000:
            yield batch()
    done()
    if out:
        yield batch()


def spellings(refs: DataFrame) -> DataFrame:
    """(last, first, n): distinct spellings as stored and how often each occurs."""
    return refs.select(F.explode("authors").alias("a")).where("a is not null").groupBy(F.coalesce("a.last", F.lit("")).alias("last"), F.coalesce("a.first", F.lit("")).alias("first")).agg(F.count("*").alias("n"))


def linked(refs: DataFrame) -> DataFrame:
    """(name, entity): every spelling that could be read and belongs to one entity only, and that entity."""
    names = cut_lineage(spellings(refs), "spellings")
    counted = names.select(F.concat_ws("|", "last", "first").alias("name"), "n")
    rows = cut_lineage(names.select("last", "first").mapInArrow(_parse, PARSED).join(counted, "name"), "parsed")
    found = people(rows.where("kind <> 'organisation'"))
    return found.unionByName(organisations(rows.where("kind = 'organisation'")))


def people(rows: DataFrame) -> DataFrame:
    """(name, entity) of people."""
    # which field is the surname: not a known given name; else the token that mostly stands in the place of one
    fold_udf, known_given = F.udf(fold, "string", useArrow=True), F.udf(lambda t: fold(t) in FULL, "boolean", useArrow=True)
    role = rows.where("kind = 'person'").select(F.col("surname").alias("token"), F.col("n").alias("as_surname"), F.lit(0).cast("long").alias("as_given"))
    given = rows.where("kind = 'person'").select(F.explode("given").alias("token"), F.lit(0).cast("long").alias("as_surname"), F.col("n").alias("as_given"))
    roles = role.unionByName(given).withColumn("token", fold_udf("token")).groupBy("token").agg(F.sum("as_surname").alias("as_surname"), F.sum("as_given").alias("as_given"))
    weight = F.coalesce(F.col("as_surname"), F.lit(0)) - F.coalesce(F.col("as_given"), F.lit(0))
    scored = rows.withColumn("token", fold_udf("surname")).join(roles, "token", "left").withColumn("weight", weight).withColumn("given_name", known_given("surname"))
    order = F.struct(~F.col("given_name"), F.col("weight"), F.col("kind") == "person")
    chosen = scored.groupBy("name").agg(F.max_by(F.struct("token", "surname", "given", "initials", "n"), order).alias("r")).select("name", F.col("r.token").alias("home"), "r.surname", "r.given", "r.initials", "r.n")
    # spellings that differ in case, marks or order only are one form
    form = F.concat_ws(" ", "home", F.array_join("given", "+"), F.array_join("initials", "."))
    chosen = cut_lineage(chosen.where("home <> ''").withColumn("form", form), "chosen")
    forms = cut_lineage(chosen.groupBy("form", "home").agg(F.min("given").alias("given"), F.min("initials").alias("initials"), F.sum("n").alias("n")), "forms")
    alts = chosen.select("home", F.udf(spelled_out, "string", useArrow=True)("surname").alias("alt")).groupBy("home").agg(F.collect_set("alt").alias("alts"))  # as many as writings with and without umlauts
    tokens = forms.groupBy("home").agg(F.sum("n").alias("n"), F.count("*").alias("forms")).join(alts, "home").withColumnRenamed("home", "token")
    others = token_neighbours(cut_lineage(tokens, "tokens")).select(F.col("token").alias("home"), F.col("other").alias("surname"), "other_n")
    others = cut_lineage(others, "others")
    placed = forms.withColumn("surname", F.col("home")).unionByName(forms.join(others.drop("other_n"), "home"))
    met = cut_lineage(placed.repartition("surname").sortWithinPartitions("surname", "form").mapInArrow(_entities, ENTITY), "entities")
    entity = F.concat("surname", F.lit("#"), "number")
    own = met.where("surname = home").select("form", entity.alias("entity"))
    guests = met.where("surname <> home").join(others, ["home", "surname"]).select("form", entity.alias("parent"), "other_n")
    # a person follows the person of another surname that most of its forms fit, the more frequent surname first
    votes = guests.join(own, "form").groupBy("entity", "parent").agg(F.count("*").alias("votes"), F.max("other_n").alias("other_n"))
    links = votes.groupBy(F.col("entity").alias("child")).agg(F.max_by("parent", F.struct("votes", "other_n", "parent")).alias("parent"))
    roots = resolve(links)
    # forms that are no person at home (initials that fit several) still are one if they fit exactly one elsewhere
    homeless = guests.join(own, "form", "left_anti").groupBy("form").agg(F.max_by("parent", F.struct("other_n", "parent")).alias("entity"))
    persons = own.unionByName(homeless).join(roots.withColumnRenamed("child", "entity"), "entity", "left").select("form", F.coalesce("root", "entity").alias("entity"))
    return chosen.select("name", "form").join(persons, "form").select("name", "entity")


def organisations(rows: DataFrame) -> DataFrame:
    """(name, entity) of organisations by their proper name: of the words that are no kind of body, the one that stands in the
    fewest spellings, counted with its misspellings."""
    words = rows.select("name", F.explode("given").alias("word"), "n").withColumn("token", F.udf(fold, "string", useArrow=True)("word")).where("token <> ''")
    alts = F.collect_set(F.udf(spelled_out, "string", useArrow=True)("word")).alias("alts")
    counts = cut_lineage(words.groupBy("token").agg(F.count_distinct("name").alias("forms"), F.sum("n").alias("n"), alts), "org-words")
    near = token_neighbours(counts).groupBy(F.col("token").alias("child")).agg(F.max_by("other", F.struct("other_n", "other")).alias("parent"))
    roots = counts.join(resolve(near), F.col("child") == F.col("token"), "left").select("token", F.coalesce("root", "token").alias("root"), "forms")
    sizes = roots.groupBy("root").agg(F.sum("forms").alias("spellings"))
    proper = words.join(roots, "token").join(sizes, "root").groupBy("name").agg(F.min_by("root", F.struct("spellings", "root")).alias("proper"))
    return proper.select("name", F.concat(F.lit("organisation "), "proper").alias("entity"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of different spellings of one entity, the smaller one first."""
    links = cut_lineage(linked(load(spark, sf_dir, "refs").select("authors")).distinct(), "links")
    sizes = links.groupBy("entity").agg(F.ceil(F.count("*") / PAIR_ROWS).cast("int").alias("parts")).where("parts > 1")
    links = links.join(sizes, "entity", "left").select("name", "entity", F.coalesce("parts", F.lit(1)).alias("parts"))
    a = links.select(F.col("name").alias("name_a"), "entity", F.pmod(F.xxhash64("name"), F.col("parts")).cast("int").alias("part"))
    b = links.select(F.col("name").alias("name_b"), "entity", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    return a.join(b, ["entity", "part"]).where("name_a < name_b").select("name_a", "name_b").distinct()


def p4_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every spelling with its entity's most frequent spelling."""
    refs = load(spark, sf_dir, "refs").select("authors")
    counted = spellings(refs).select(F.concat_ws("|", "last", "first").alias("name"), "n")
    rows = linked(refs).distinct().join(counted, "name")
    best = rows.groupBy("entity").agg(F.max_by("name", F.struct("n", "name")).alias("preferred"))
    return rows.join(best, "entity").select("name", "preferred", "n")
