"""Problem 7: variant spellings of the names of people and organisations, linked by their canonical rewritings.

Every name is rewritten: accents and look-alike letters folded, titles, credentials, legal forms and bracketed remarks
dropped, nicknames and abbreviations traced to full words, turned-round parts put in order.  The result is a signature
(given name, family name, generation; or qualifier, own name, line of business, number).  Its forms are all texts that a
variant with one more slip could also be rewritten to: the own name with each single letter left out, with the initial
or the qualifier and number beside it.  Forms are equi-joined; a pair is weighed by the rarity of the forms it shares
and then checked exactly.  Equal signatures are collapsed first, so many rows with one spelling cost one candidate.
"""

from __future__ import annotations

import re
import unicodedata

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.components import connected
from ledgerloom.operators.skew import join_pairs
from ledgerloom.session import cut

# Given names with their short and foreign forms.
GIVEN = {
    "abigail": "abby gail", "abraham": "abe bram ibrahim", "adelaide": "addie adele", "albert": "al bert alberto", "alexander": "alex alec sandy sasha xander alejandro alexandre", "alfred": "alf alfie fred alfredo",
    "amanda": "mandy", "andrew": "andy drew andre andres andrei", "angela": "angie", "anne": "ann annie anna ana nancy", "anthony": "antony tony anton antonio", "arthur": "art artie arturo",
    "barbara": "barb babs", "beatriz": "bea beatrice beatrix", "benjamin": "ben benny benji", "bernard": "bernie bernardo", "bjorn": "bjoern", "bradley": "brad", "caroline": "carol carrie carolina",
    "charles": "chas chuck charlie charley carlos karl", "charlotte": "lottie", "christina": "christine tina kristina kristen", "christopher": "chris kit", "cynthia": "cindy", "daniel": "dan danny", "david": "dave davy", "deborah": "deb debbie debra",
    "dmitri": "dima dimitri dmitry dmitriy", "donald": "don donny", "dorothy": "dot dottie", "douglas": "doug", "edward": "ed eddie ned ted eduardo", "eleanor": "ellie nell nora leonor", "elizabeth": "liz beth betsy betty lizzie eliza elisabeth", "emily": "em emmy", "eugene": "gene", "florence": "flo flossie",
    "francisco": "paco pancho frank francis", "frederick": "fred freddy freddie fredrick frederic", "gabriel": "gabe gabby", "geoffrey": "geoff jeff jeffrey jeffery", "george": "georgie jorge", "gerald": "gerry jerry", "gregory": "greg gregg", "guadalupe": "lupe lupita", "harold": "hal harry", "harriet": "hattie harriett",
    "helene": "helen helena", "henry": "hank henri enrique", "ingrid": "inga", "isabella": "bella izzy isabel", "jacob": "jake", "jacqueline": "jackie jaqueline jacquelyn", "james": "jas jim jimmy jamie", "jennifer": "jen jenny", "jessica": "jess jessie", "john": "jack johnny jon juan", "jonathan": "jonny nathan",
    "jose": "pepe josep joseph joe joey", "joshua": "josh", "judith": "judy", "katherine": "kate kathy katie catherine kathryn katharine", "kenneth": "ken kenny", "kwame": "kwami", "lawrence": "larry laurence lars", "leonard": "len lenny", "louis": "lou louie luis", "margaret": "meg maggie peggy marge",
    "martin": "marty", "mary": "maria marie molly", "matthew": "matt matty mateo", "michael": "mike mick miguel", "mohammed": "mohamed muhammad mohammad mo md", "nathaniel": "nate nathan nat", "nicholas": "nick nicky nicolas nico", "olga": "olya", "pamela": "pam", "patricia": "pat patty trish tricia", "patrick": "paddy pat", "peter": "pete pedro pyotr",
    "philip": "phil phillip felipe", "quentin": "quent", "rachel": "rae", "raymond": "ray", "rebecca": "becky becca", "richard": "rick rich dick ricky ricardo", "robert": "bob rob bobby robbie bert roberto", "ronald": "ron ronnie", "samantha": "sammy", "samuel": "sam sammy", "sandra": "sandy", "sarah": "sally sara", "stephanie": "steph",
    "stephen": "steve steven stefan esteban", "susannah": "sue suzy susanna susan susie susana", "theodore": "ted theo teddy", "theresa": "terry tess teresa", "thomas": "tom tommy tomas", "timothy": "tim timmy", "ursula": "ulla uschi", "victoria": "vicky tori vickie vicki", "vincent": "vince vinny vicente",
    "virginia": "ginny", "walter": "walt wally", "wendell": "wen", "william": "will bill wm billy willie liam", "xavier": "xavi javier", "yusuf": "yousef youssef yusef", "zachary": "zach zack", "zoe": "zoey",
}
TITLES = frozenset("mr mrs ms miss mx dr prof professor hon rev sir dame lord lady judge capt col sr. fr".split()) - {"sr."}
CREDENTIALS = frozenset("cpa esq md phd jd mba rn dds do pe facs".split())
GENERATIONS = {"jr": "jr", "junior": "jr", "sr": "sr", "senior": "sr", "ii": "ii", "iii": "iii", "iv": "iv", "2nd": "ii", "3rd": "iii"}
LEGAL = frozenset("inc incorporated llc corp corporation co company ltd limited lp llp plc gmbh sa ag the".split())
QUALIFIERS = "north south east west greater international united metropolitan saint first second new central upper lower national american".split()
LINES = (
    "services association foundation society management senior support recycling family literacy solutions transit fund health youth childcare housing workforce cultural technology legal veterans water aid "
    "trust construction heritage public community education arts neighborhood safety consultants council paving partners environmental food development center network contractors alliance cooperative "
    "assistance collective bank institute program engineering district group systems university school hospital clinic church library museum"
).split()
NUMBERED = frozenset("chapter branch lodge post local unit no number".split())
_NICK: dict[str, set[str]] = {}
for _full, _short in GIVEN.items():
    for _x in [_full, *_short.split()]:
        _NICK.setdefault(_x, set()).add(_full)


def fold(text: str) -> str:
    """Lower case without accents, with letters that scanners confuse made alike."""
    text = "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c)).casefold()
    return text.replace("ß", "ss").replace("ø", "o").replace("æ", "ae").replace("ł", "l")


def _blur(word: str) -> str:
    return word.replace("rn", "m").replace("vv", "w").replace("0", "o").replace("1", "l") if not word.isdigit() else word


def near(a: str, b: str) -> bool:
    """At most one letter added, left out, replaced or swapped with its neighbour."""
    if a == b:
        return True
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1:
        return False
    i = 0
    while i < len(a) and a[i] == b[i]:
        i += 1
    if len(a) == len(b):
        return a[i + 1 :] == b[i + 1 :] or (i + 1 < len(a) and a[i] == b[i + 1] and a[i + 1] == b[i] and a[i + 2 :] == b[i + 2 :])
    return a[i:] == b[i + 1 :]


def abbreviates(short: str, full: str) -> bool:
    """Same first letter, and the letters of ``short`` in their order within ``full``."""
    if len(short) < 2 or len(short) >= len(full) or short[0] != full[0]:
        return False
    at = iter(full)
    return all(c in at for c in short)


def alike(a: str, b: str) -> bool:
    """``near`` as written, or with letters that scanners confuse made alike."""
    return near(a, b) or near(_blur(a), _blur(b))


def same_word(a: str, b: str) -> bool:
    return a == b or (min(len(a), len(b)) >= 4 and alike(a, b)) or abbreviates(a, b) or abbreviates(b, a)


def _shorter(word: str) -> set[str]:
    """A word, its blurred form, and both with each single letter left out: words with a slip between them share one."""
    return {x for w in {word, _blur(word)} for x in (w, *(w[:i] + w[i + 1 :] for i in range(len(w))))}


class _Near:
    """Words of at least four letters, by what a spelling of them with one slip may be shortened to."""

    def __init__(self, known) -> None:
        self.by: dict[str, list[str]] = {}
        for x in known:
            if len(x) >= 4:
                for y in _shorter(x):
                    self.by.setdefault(y, []).append(x)

    def to(self, token: str) -> list[str]:
        """The words that ``token``, of four letters or more, is like, in the order they were given."""
        found = dict.fromkeys(x for y in _shorter(token) for x in self.by.get(y, ()))
        return [x for x in found if alike(token, x)]


_GIVEN_MEMO: dict[str, frozenset[str]] = {}
_GIVEN_NEAR = _Near(_NICK)


def given_names(token: str) -> frozenset[str]:
    """Full given names a token may stand for; empty if it is none that is known, near spellings included."""
    known = _GIVEN_MEMO.get(token)
    if known is None:
        hit = _NICK.get(token) or _NICK.get(_blur(token))
        if hit is None and len(token) >= 4:
            hit = {full for x in _GIVEN_NEAR.to(token) for full in _NICK[x]}
        known = frozenset(hit or ())
        if len(_GIVEN_MEMO) < 500_000:
            _GIVEN_MEMO[token] = known
    return known


def person(name: str) -> tuple[str, str, str] | None:
    """(given names or initial, family name, generation)."""
    text = fold(name)
    sides = [s for s in (re.findall(r"[^\s,]+", part) for part in text.split(",")) if s]
    generation = ""
    cleaned: list[list[str]] = []
    for side in sides:
        kept = []
        for t in side:
            bare = re.sub(r"[\W_]", "", t)
            if bare in GENERATIONS:
                generation = GENERATIONS[bare]
            elif bare and bare not in TITLES and (bare not in CREDENTIALS or (bare == "md" and not kept and (len(side) > 1 or (cleaned and len(cleaned[0]) == 1)))):
                kept.append(bare)  # Md. ahead of a family name is short for Mohammed
        if kept:
            cleaned.append(kept)
    if not cleaned:
        return None
    if len(cleaned) >= 2:
        family, first = cleaned[0], cleaned[1] + [t for s in cleaned[2:] for t in s]
    else:
        tokens = cleaned[0]
        if len(tokens) == 1:
            return ("", tokens[0], generation)
        ahead, behind = bool(given_names(tokens[0])) or len(tokens[0]) == 1, bool(given_names(tokens[-1]))
        exact_ahead, exact_behind = tokens[0] in _NICK, tokens[-1] in _NICK
        turned = (behind and not ahead) or (exact_behind and not exact_ahead and len(tokens[0]) > 1)
        if turned:
            first, family = [tokens[-1]], [t for t in tokens[:-1]]
        else:
            first, family = [tokens[0]], tokens[1:]
    own = "".join(t for t in family if len(t) > 1) or "".join(family)
    given = next((t for t in first if len(t) > 1), first[0])
    if len(first[0]) == 1 and len(given) > 1 and not given_names(given):
        given = first[0]
    full = given_names(given)
    return ("|".join(sorted(full)) if full else given, own, generation)


_GENERIC_MEMO: dict[str, tuple[str, str]] = {}
_KIND = dict.fromkeys(QUALIFIERS, "q") | dict.fromkeys(LINES, "l")
_GENERIC_NEAR = _Near(_KIND)


def _generic(token: str) -> tuple[str, str]:
    """('q', full) for a qualifier, ('l', full) for a word of a line of business, ('', token) for an own name."""
    hit = _GENERIC_MEMO.get(token)
    if hit is None:
        hit = ("q", "saint") if token == "st" else ("", token)
        if token in _KIND:
            hit = (_KIND[token], token)
        if not hit[0]:
            options = sorted((_KIND[x], x) for x in _GENERIC_NEAR.to(token)) if len(token) >= 4 else []
            if len(token) <= 8:
                options += [(k, x) for k, group in (("l", LINES), ("q", QUALIFIERS)) for x in group if abbreviates(token, x) and (k == "l" or token in ("intl", "metro", "natl", "no", "so"))]
            hit = (options[0][0], options[0][1] if len({o[1] for o in options}) == 1 else token) if options else hit
        if len(_GENERIC_MEMO) < 500_000:
            _GENERIC_MEMO[token] = hit
    return hit


def organisation(name: str) -> tuple[str, str, str, str] | None:
    """(qualifier, own name, words of the line of business, number)."""
    text = re.sub(r"\([^)]*\)|\[[^\]]*\]", " ", fold(name))
    text = re.sub(r"(?<=\w)['’.\-](?=\w)", "", re.sub(r"\b((?:[a-z]\.){2,})", lambda m: m[1].replace(".", ""), text))
    tokens = re.findall(r"[^\W_]+", text)
    number, qualifier, own, line = "", [], [], []
    for i, t in enumerate(tokens):
        if t.isdigit():
            number = number or t.lstrip("0") or "0"
        elif t in NUMBERED and i + 1 < len(tokens) and tokens[i + 1].isdigit() or t in LEGAL or t in ("of", "and", "for", "de"):
            continue
        else:
            kind, full = _generic(t)
            (qualifier if kind == "q" else line if kind == "l" else own).append(full)
    if not own:
        own = qualifier + line
        if not own:
            return None
    return (" ".join(sorted(set(qualifier))), "".join(own), " ".join(line), number)


def same_line(a: str, b: str) -> bool:
    """Lines of business agree word by word as far as the shorter one goes; a missing line agrees with none."""
    x, y = a.split(), b.split()
    if not x or not y:
        return not x and not y
    return all(same_word(p, q) for p, q in zip(x, y))


def same_given(a: str, b: str) -> bool:
    if len(a) == 1 or len(b) == 1:
        return any(x.startswith(y) for x in a.split("|") for y in b.split("|")) or any(y.startswith(x) for x in a.split("|") for y in b.split("|"))
    return bool(set(a.split("|")) & set(b.split("|"))) or (bool(a and b) and min(len(a), len(b)) >= 4 and "|" not in a + b and a not in GIVEN and b not in GIVEN and alike(a, b))


def same_party(kind: str, a: str, b: str) -> bool:
    """Whether two signatures, as written by ``sign``, name one party."""
    x, y = a.split("\t"), b.split("\t")
    if kind == "person":
        return (x[1] == y[1] or (min(len(x[1]), len(y[1])) >= 4 and alike(x[1], y[1]))) and same_given(x[0], y[0]) and (not x[2] or not y[2] or x[2] == y[2])
    return x[0] == y[0] and x[3] == y[3] and (x[1] == y[1] or (min(len(x[1]), len(y[1])) >= 5 and alike(x[1], y[1]))) and same_line(x[2], y[2])


def sign(kind: str, name: str) -> tuple[str, list[str]] | None:
    """A name's signature and its forms."""
    parts = person(name) if kind == "person" else organisation(name)
    if parts is None or not parts[1]:
        return None
    word = parts[1]
    shorter = {word} | {w[:i] + w[i + 1 :] for w in (word, _blur(word)) for i in range(len(w)) if len(w) >= 4} | {_blur(word)}
    beside = {g[:1] for g in parts[0].split("|")} if kind == "person" else {f"{parts[0]}/{parts[3]}"}
    return "\t".join(parts), sorted(f"{b}:{s}" for b in beside for s in shorter)


def signatures(entities: DataFrame, aliases: DataFrame) -> DataFrame:
    """(entity_id, kind, sig, forms) of every spelling of the entities that take part.

    Composites, rows without norm_key, id or name, and types other than person and org take no part; aliases count for
    the entity they are filed under if it takes part.
    """
    part = entities.where(F.col("entity_type").isin("person", "org") & F.col("norm_key").isNotNull() & (F.coalesce(F.col("is_intermediary_composite"), F.lit(0)) != 1) & F.col("entity_id").isNotNull())
    own = part.select("entity_id", F.col("entity_type").alias("kind"), F.col("canonical_name").alias("name"))
    filed = aliases.select("entity_id", F.col("raw_name").alias("name")).join(own.select("entity_id", "kind"), "entity_id").select("entity_id", "kind", "name")
    names = own.unionByName(filed).where("name IS NOT NULL").distinct()

    def run(batches):
        for batch in batches:
            rows = []
            for e, k, n in zip(*(batch.column(i).to_pylist() for i in range(3))):
                signed = sign(k, n)
                if signed:
                    rows.append((e, k, *signed))
            kinds = [pa.int64(), pa.string(), pa.string(), pa.list_(pa.string())]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kinds[i]) for i in range(4)], ["entity_id", "kind", "sig", "forms"])

    return names.mapInArrow(run, "entity_id bigint, kind string, sig string, forms array<string>")


def links(signed: DataFrame, common: int = 100) -> DataFrame:
    """(kind, sig_a, sig_b, weight): checked links between different signatures, sig_a < sig_b.

    A pair's weight is the sum over its shared forms of one over the signatures that have the form.  A pair whose forms
    are all so common that it weighs less than one over the root of the number of signatures (or over ``common``, if that
    is more) is no link, as so many unrelated names share as much.  A link from a bare initial is kept only if one given
    name fits all it could stand for; one from a name without generation only if it meets a single generation.
    """
    own = signed.select("kind", "sig", "forms").dropDuplicates(["kind", "sig"])
    bound = own.groupBy("kind").agg((1.0 / F.greatest(F.sqrt(F.count("*")), F.lit(float(common)))).alias("least"))
    forms = own.select("kind", "sig", F.explode("forms").alias("form"))
    rarity = forms.groupBy("kind", "form").agg(F.count("*").alias("n")).where("n > 1")
    forms = cut(forms.join(rarity, ["kind", "form"]))
    a, b = forms.withColumnRenamed("sig", "sig_a"), forms.select("kind", "form", F.col("sig").alias("sig_b"))
    pairs = join_pairs(a, b, ["kind", "form"], "sig_a").where("sig_a < sig_b").groupBy("kind", "sig_a", "sig_b").agg(F.sum(F.lit(1.0) / F.col("n")).alias("weight"))
    pairs = pairs.join(F.broadcast(bound), "kind").where("weight >= least").drop("least")  # one row per kind

    def run(batches):
        for batch in batches:
            keep = [same_party(k, x, y) for k, x, y in zip(*(batch.column(i).to_pylist() for i in range(3)))]
            yield batch.filter(pa.array(keep, pa.bool_()))

    good = cut(pairs.mapInArrow(run, "kind string, sig_a string, sig_b string, weight double"))
    both = good.select("kind", F.col("sig_a").alias("sig"), F.col("sig_b").alias("other")).unionByName(good.select("kind", F.col("sig_b").alias("sig"), F.col("sig_a").alias("other"))).where("kind = 'person'")
    part = lambda c, i: F.split_part(F.col(c), F.lit("\t"), F.lit(i))
    given, other_given = part("sig", 1), part("other", 1)
    met = both.where((F.length(given) == 1) & (F.length(other_given) > 1)).select("sig", other_given.alias("given")).distinct()
    fits = met.select("sig", F.explode(F.split("given", r"\|")).alias("name")).groupBy("sig", "name").agg(F.count("*").alias("n")).groupBy("sig").agg(F.max("n").alias("n"))
    initials = met.groupBy("sig").agg(F.count("*").alias("k")).join(fits, "sig").where("n < k").select("sig")
    ages = both.where((part("sig", 3) == "") & (part("other", 3) != "")).groupBy("sig").agg(F.count_distinct(part("other", 3)).alias("k")).where("k > 1").select("sig")
    for doubtful, concerns in ((initials, None), (ages, 3)):
        for side, other in (("sig_a", "sig_b"), ("sig_b", "sig_a")):
            bad = good.join(doubtful.withColumnRenamed("sig", side), side, "left_semi")
            if concerns:
                bad = bad.where(part(other, concerns) != "")
            good = good.join(bad.select("kind", "sig_a", "sig_b"), ["kind", "sig_a", "sig_b"], "left_anti")
    return good


def party_pairs(entities: DataFrame, aliases: DataFrame) -> DataFrame:
    """(entity_id_a, entity_id_b), smaller first: every pair of entities that name one party.

    Links are closed transitively, since two slips in one name show only through a third spelling; a pair whose own
    generations differ is not given out.  Empty tables give no rows; repeated rows count once.
    """
    signed = cut(signatures(entities, aliases))
    reps = signed.groupBy("kind", "sig").agg(F.min("entity_id").alias("rep"))
    good = links(signed)
    across = good.join(reps.select("kind", F.col("sig").alias("sig_a"), F.col("rep").alias("a")), ["kind", "sig_a"]).join(reps.select("kind", F.col("sig").alias("sig_b"), F.col("rep").alias("b")), ["kind", "sig_b"]).select("a", "b")
    within = signed.join(reps, ["kind", "sig"]).select(F.col("rep").alias("a"), F.col("entity_id").alias("b"))
    edges = across.unionByName(within).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct()
    found = cut(connected(edges))
    members = found.select("group_id", F.col("id")).unionByName(found.select("group_id", F.col("group_id").alias("id")).distinct())
    ages = signed.where("kind = 'person'").select(F.col("entity_id").alias("id"), F.split_part("sig", F.lit("\t"), F.lit(3)).alias("age")).where("age <> ''").groupBy("id").agg(F.max("age").alias("age"))
    members = cut(members.join(ages, "id", "left"))
    a, b = members.select("group_id", F.col("id").alias("entity_id_a"), F.col("age").alias("_a")), members.select("group_id", F.col("id").alias("entity_id_b"), F.col("age").alias("_b"))
    pairs = join_pairs(a, b, ["group_id"], "entity_id_a").where("entity_id_a < entity_id_b AND (_a IS NULL OR _b IS NULL OR _a = _b)")
    return pairs.select("entity_id_a", "entity_id_b")


def weighed_links(entities: DataFrame, aliases: DataFrame) -> DataFrame:
    """(kind, sig_a, sig_b, weight): the links themselves, heaviest where the shared forms are rare."""
    signed = cut(signatures(entities, aliases))
    return links(signed).select("kind", F.translate("sig_a", "\t", "/").alias("name_a"), F.translate("sig_b", "\t", "/").alias("name_b"), F.round("weight", 6).alias("weight"))
