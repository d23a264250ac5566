"""Problem 3: entries that write the address of the same building differently.

1. Each distinct writing is read into parts: house number, street name, street
   type, direction, postal code and town. Units, floors, countries, business names
   in front and the state carry no identity and are left out.
2. Parts that an entry lacks are filled in from other entries of the same site,
   house number and street name where those agree, and towns from the postal codes
   they stand with. Names that differ by typing errors within a site count as one there.
3. What is left of a writing, in one spelling of its parts, becomes a vector of
   weighted character n-grams of the whole address. Candidates come from an inverted
   index keyed by house number, place and n-gram, of which only the prefix of the
   rarest n-grams is indexed that the cosine threshold requires. House numbers are
   compatible by construction; the place is the postal code, for an entry without one
   each town that its town may be, and for one that names no place any.
4. Candidates are verified by the cosine of the whole vectors, and then no part may
   contradict: street names up to typing errors, street type, direction, postal code
   and town; a part missing on one side does not, nor does a place of which an entry
   says nothing.

The index runs over distinct addresses, so neither copies nor a street that many
towns have multiply before the last step, which lists the pairs of entries.

Defined results: null arrays, null entries and entries without a house number or
street give no pairs; arrays of unequal length are read up to the shorter one; an
entry is never paired with itself; a value_id that is repeated counts once; a single
number of five digits is a house number where there is no other.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from .base import cut, python_ready, spread

#: Least cosine of two whole addresses, of two street names (or towns) that are looked at for typing errors, and length of the n-grams.
COSINE, NAME_COSINE, GRAM = 0.4, 0.2, 2

#: Street types and their writings (fixed values).
_TYPES_EN = {
    "st": "st str street", "ave": "ave av avenue aven", "rd": "rd road", "blvd": "blvd boulevard boul", "dr": "dr drive drv", "ln": "ln lane", "ct": "ct court crt",
    "pl": "pl place", "hwy": "hwy highway", "pkwy": "pkwy parkway pky", "cir": "cir circle", "way": "way wy", "ter": "ter terrace terr", "sq": "sq square",
    "aly": "aly alley", "trl": "trl trail", "loop": "loop", "row": "row", "walk": "walk", "path": "path", "plz": "plz plaza", "xing": "xing crossing", "bnd": "bnd bend", "cv": "cv cove",
}
_TYPES_FR = {
    "rue": "rue r", "av": "avenue av ave", "bd": "boulevard bd blvd boul bld", "pl": "place pl", "ch": "chemin ch chem", "all": "allee all", "imp": "impasse imp", "quai": "quai q",
    "rte": "route rte", "crs": "cours crs", "sq": "square sq", "pass": "passage pass", "fg": "faubourg fg fbg",
}
_TYPES_DE = {"str": "strasse str", "weg": "weg w", "gasse": "gasse g", "allee": "allee al", "platz": "platz pl", "ring": "ring", "damm": "damm", "ufer": "ufer", "markt": "markt", "steig": "steig", "pfad": "pfad"}
_EN = {w: t for t, ws in _TYPES_EN.items() for w in ws.split()}
_FR = {w: t for t, ws in _TYPES_FR.items() for w in ws.split()}
_DE = {w: t for t, ws in _TYPES_DE.items() for w in ws.split()}
_DE_SUFFIX = re.compile(r"^(.{3,}?)-?(strasse|str|gasse|allee|platz|weg|ring|damm|ufer|steig|pfad|markt|g|w|pl|al)\.?$")
_PARTICLES = frozenset("de des du d la le les l a aux au".split())
_DIRECTIONS = {w: d for d, ws in {"n": "n north", "s": "s south", "e": "e east", "w": "w west", "ne": "ne northeast", "nw": "nw northwest", "se": "se southeast", "sw": "sw southwest"}.items() for w in ws.split()}
_STATES = frozenset(
    """al ak az ar ca co ct de fl ga hi id il in ia ks ky la me md ma mi mn ms mo mt ne nv nh nj nm ny nc nd oh ok or pa ri sc sd tn tx ut vt va wa wv wi wy dc
    alabama alaska arizona arkansas california colorado connecticut delaware florida georgia hawaii idaho illinois indiana iowa kansas kentucky louisiana maine maryland
    massachusetts michigan minnesota mississippi missouri montana nebraska nevada ohio oklahoma oregon pennsylvania tennessee texas utah vermont virginia washington wisconsin wyoming""".split()
)
_TWO_WORD_STATE = re.compile(r"\b(?:new (?:york|jersey|mexico|hampshire)|(?:north|south) (?:carolina|dakota)|west virginia|rhode island)\b")
_COUNTRY = re.compile(r"\b(?:u\.?s\.?a\.?|united states(?: of america)?|deutschland|germany|france|frankreich|allemagne|etats-unis)(?=$|[\s,;.\n-])")
_UNIT = re.compile(
    r"(?:#\s*[\w-]+|\b(?:ste|suite|unit|apt|apartment|room|rm|fl|floor|bldg|building|bat|batiment|app|appt|appartement|esc|wohnung|whg|top|hinterhaus|etage)\b\.?\s*(?:#|nr\.?\s*|no\.?\s*)?(?!\d{5}(?:-\d{4})?(?!\w))[\w-]*\d[\w-]*"
    r"|\b\d+\s*(?:\.|e|er|eme|st|nd|rd|th)?\s*(?:etage|og|ug|stock|floor|fl)\b\.?|\b(?:eg|erdgeschoss|rez-de-chaussee|rdc)\b)"
)
_NUMBER_MARK = re.compile(r"\b(?:no|nr|num|number|hausnummer)\b\.?\s*(?=\d)|n°\s*(?=\d)")
_ZIP = re.compile(r"\b(?:[a-z]{1,2}-)?(\d{5})(?:-\d{4})?\b")
_HOUSE = re.compile(r"\d{1,6}(?:\s?-\s?\d{1,6})?(?:[a-d]|bis|ter)?")
_OTHER_NUMBER = re.compile(r"(?<![\w-])\d{1,4}(?:[a-d]|bis|ter)?(?![\w-])|\d{6}")
_AFTER_TYPE = re.compile(r"(?:strasse|str|gasse|allee|platz|weg|ring|damm|ufer|steig|pfad|markt)\.?\s*$")


def fold(text: str) -> str:
    """Lower case without accents; umlauts are written out."""
    text = text.lower()
    for mark, letters in (("ä", "ae"), ("ö", "oe"), ("ü", "ue"), ("ß", "ss"), ("œ", "oe"), ("æ", "ae"), ("’", "'"), ("\xa0", " ")):
        text = text.replace(mark, letters)
    return "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c))


def read(value: str | None) -> dict[str, str] | None:
    """The parts of one writing: house, name, kind, way (direction), zip, town and whether the town is set off; None without house and name."""
    if not value:
        return None
    text = unicodedata.normalize("NFC", value)
    text = fold(text)
    text = _COUNTRY.sub(" | ", text)
    text = _TWO_WORD_STATE.sub(lambda m: " @ ", text)
    text = _UNIT.sub(" | ", text)
    text = _NUMBER_MARK.sub("", text)
    zips = list(_ZIP.finditer(text))
    if len(zips) == 1 and not _OTHER_NUMBER.search(text[: zips[0].start()] + " " + text[zips[0].end() :]):
        zips = []
    code = ""
    if zips:
        mark = zips[-1]
        if len(zips) > 1 and (re.match(r"\s*\d", text[mark.end() :]) or _AFTER_TYPE.search(text[: mark.start()])):
            mark = zips[0]
        code = mark[1]
        text = f"{text[: mark.start()]} ~ {text[mark.end() :]}"
    text = re.sub(r"(?<=[a-z]{3})g\.(?=[\s,;]|$)", "gasse", text)
    text = re.sub(r"[,;\n()]|\s[-–—|]\s|\s-|-\s|\|", " | ", text)
    text = re.sub(r"(?<=[a-z])\.(?=\s|$|[^\w])", " ", text)
    words = [w.strip(".'\"") for w in text.replace("'", " ").split()]
    words = [w for w in words if w]
    at = next((k for k, w in enumerate(words) if _HOUSE.fullmatch(w) and any(c.isdigit() for c in w)), None)
    if at is None:
        return None
    house = words[at].replace(" ", "")
    before, after = words[:at], words[at + 1 :]
    if after and after[0] in ("bis", "ter", "a", "b", "c") and len(after) > 1 and after[1] != "|":
        house, after = house + after[0], after[1:]
    name, kind, way, used_before, used_after = _street(before, after)
    if not name:
        return None
    rest = before[: len(before) - used_before] + ["|"] + after[used_after:]
    marked = kind[:3] in ("en:", "de:") or "~" in before or bool(_town(["|", *after[used_after:]]))
    return {"house": house, "name": name, "kind": kind, "way": way, "zip": code, "town": _town(rest), "marked": "1" if marked else ""}


def _street(before: list[str], after: list[str]) -> tuple[str, str, str, int, int]:
    """(name, kind, direction, words used before the number, words used after it)."""
    if before and before[-1] not in ("|", "~", "@"):
        last = before[-1]
        if last in _DE and len(last) > 1 and len(before) > 1 and before[-2] not in ("|", "~", "@") and (not after or after[0] in ("|", "~", "@") or after[0] not in _FR):
            return before[-2].replace("-", ""), "de:" + _DE[last], "", 2, 0
        m = _DE_SUFFIX.match(last)
        strong = m and m[2] in ("strasse", "str", "gasse", "allee", "platz", "weg", "ring", "damm", "ufer", "steig", "pfad", "markt")
        if m and (strong or not after or after[0] in ("|", "~", "@")):
            return m[1].replace("-", ""), "de:" + _DE[m[2]], "", 1, 0
    stop = next((k for k, w in enumerate(after) if w in ("|", "~", "@")), len(after))
    if stop == 0 and after[:1] == ["|"]:
        shift = 1
        name, kind, way, _, used = _street([], after[1:])
        return name, kind, way, 0, used + shift
    run = after[:stop]
    french = len(run) > 1 and run[0] in _FR and (run[1] in _PARTICLES or run[0] not in _DIRECTIONS and run[-1] not in _EN)
    if french:
        words = [w for w in run[1:] if w not in _PARTICLES]
        return " ".join(words), "fr:" + _FR[run[0]], "", 0, len(run)
    way, k = "", 0
    if len(run) > 1 and run[0] in _DIRECTIONS and run[1] not in _EN:
        way, k = _DIRECTIONS[run[0]], 1
    end = next((j for j in range(k + 1, len(run)) if run[j] in _EN), None)
    if end is not None:
        while end + 1 < len(run) and run[end + 1] in _EN:
            end += 1
        used = end + 1
        if used < len(run) and run[used] in _DIRECTIONS and not way:
            way, used = _DIRECTIONS[run[used]], used + 1
        return " ".join(run[k:end]), "en:" + _EN[run[end]], way, 0, used
    used = len(run) - 1 if len(run) > k + 1 and run[-1] in _STATES else len(run)
    return " ".join(run[k:used]), "", way, 0, used


def _town(rest: list[str]) -> str:
    """The word beside postal code or state, else the last word that is left."""
    plain = [w for w in rest if w.isalpha() or "-" in w]
    for k, w in enumerate(rest):
        if w in ("~", "@") or w in _STATES:
            back = k - 1
            while back >= 0 and (rest[back] in ("~", "@", "|") or rest[back] in _STATES):
                back -= 1
            ahead = rest[k + 1] if w == "~" and k + 1 < len(rest) else "|"
            if ahead not in ("|", "~", "@") and ahead not in _STATES and ahead.replace("-", "").isalpha():
                return ahead
            if back >= 0 and len(rest[back]) > 2 and rest[back] not in _DE and rest[back].replace("-", "").isalpha():
                return rest[back]
    left = [w for w in plain if w not in _STATES and w not in _EN and w not in _PARTICLES and len(w) > 2]
    tail = []
    for w in reversed(rest):
        if w == "|" and tail:
            break
        if w in left:
            tail.append(w)
    return tail[0] if tail else ""


def edits(a: str, b: str, most: int = 3) -> int:
    """Edit distance with swaps of neighbours, ``most`` at most."""
    if a == b:
        return 0
    if abs(len(a) - len(b)) >= most:
        return most
    two, one = None, list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            cost = min(one[j] + 1, row[-1] + 1, one[j - 1] + (x != y))
            if two and i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                cost = min(cost, two[j - 2] + 1)
            row.append(cost)
        if min(row) >= most and (two is None or min(one) >= most):
            return most
        two, one = one, row
    return min(most, one[-1])


def alike(a: str, b: str) -> bool:
    """Whether two names differ by typing errors at most: none in names of less than five letters, where one letter makes another name, one in short names, one for each side in longer ones."""
    shorter = min(len(a), len(b))
    return a == b or shorter > 4 and edits(a, b) <= (1 if shorter < 6 else 2)


_FORM = "house string, name string, kind string, way string, zip string, town string"
_READ = f"{_FORM}, marked string"


def _read_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = []
        for value in pdf["value"]:
            parts = read(value)
            if parts:
                rows.append((value, *parts.values()))
        yield pd.DataFrame(rows, columns=["value", "house", "name", "kind", "way", "zip", "town", "marked"])


def entries(reports: DataFrame) -> DataFrame:
    """(value_id, site, value) of every full address."""
    zipped = F.arrays_zip(F.col("values").alias("v"), F.col("value_ids").alias("i"))
    return (
        reports.filter((F.col("field") == "full_address") & F.col("values").isNotNull() & F.col("value_ids").isNotNull())
        .select("site", F.explode(zipped).alias("e"))
        .select(F.col("e.i").alias("value_id"), "site", F.col("e.v").alias("value"))
        .filter(F.col("value_id").isNotNull() & F.col("value").isNotNull())
        .dropDuplicates(["value_id"])
    )


def _set_off(rows: DataFrame) -> DataFrame:
    """Names that run on into the town are cut before it, by the towns that other entries name.

    A name that some entry of the house number writes apart from its town stays
    whole. A misspelt town counts if an entry of the house number has both parts alike.
    """
    runs_on = (F.col("marked") == "") & F.col("name").contains(" ")
    tail = F.substring_index("name", " ", -1)
    apart = rows.filter("marked <> ''")
    runs = rows.filter(runs_on).select("house", "name").distinct().join(apart.select("house", "name").distinct(), ["house", "name"], "left_anti")
    runs = cut(runs.withColumn("tail", tail).withColumn("front", F.expr("substring(name, 1, length(name) - length(tail) - 1)")))
    known = runs.join(apart.filter("town <> '' AND zip <> ''").select(F.col("town").alias("tail")).distinct(), "tail", "left_semi").select("house", "name", "front", "tail")
    others = apart.filter("town <> ''").select("house", F.col("name").alias("front_b"), F.col("town").alias("tail_b")).distinct()
    misspelt = runs.join(known.select("house", "name"), ["house", "name"], "left_anti").join(others, "house").filter(alike_udf("front", "front_b") & alike_udf("tail", "tail_b"))
    cuts = cut(known.unionByName(misspelt.select("house", "name", "front", "tail").distinct()))
    out = rows.join(cuts, ["house", "name"], "left").withColumn("town", F.when(runs_on & F.col("tail").isNotNull(), F.col("tail")).otherwise(F.col("town")))
    return out.withColumn("name", F.when(runs_on & F.col("front").isNotNull(), F.col("front")).otherwise(F.col("name"))).drop("front", "tail", "marked")


def _usual_names(rows: DataFrame) -> DataFrame:
    """(site, house, name, stands_for): within a site a name stands for the most frequent of those it is alike to."""
    key = F.concat_ws("\x01", F.coalesce("site", F.lit("")), "house")
    counts = cut(rows.groupBy("site", "house", "name").agg(F.count("*").alias("n")).withColumn("group", key))
    met = similar_names(counts.select("group", "name"))
    best = F.max_by("name_b", F.struct(F.col("n"), F.col("name_b"))).alias("stands_for")
    usual = met.join(counts.select("group", F.col("name").alias("name_b"), "n"), ["group", "name_b"]).groupBy("group", F.col("name_a").alias("name")).agg(best)
    return counts.join(usual, ["group", "name"]).select("site", "house", "name", "stands_for")


@F.pandas_udf(T.BooleanType())
def one_place(towns: pd.Series) -> pd.Series:
    """Whether all of the towns can be one."""
    return pd.Series([all(alike(x, y) for k, x in enumerate(ts) for y in ts[:k]) for ts in (sorted(t) for t in towns)], dtype=bool)


def _filled(rows: DataFrame) -> DataFrame:
    """Parts an entry lacks, from entries of its site with the same house number and street name where those agree.

    A code is filled in only where no town is written, and only if the towns of those entries can be one.
    """
    by = ["site", "house", "stands_for"]
    towns = rows.filter((F.col("zip") != "") & (F.col("town") != "")).groupBy("zip", "town").count()
    usual = cut(towns.groupBy("zip").agg(F.max_by("town", F.struct("count", "town")).alias("usual")))
    placed = rows.join(usual, "zip", "left").withColumn("place", F.nullif(F.coalesce("usual", "town"), F.lit("")))
    one = lambda c: F.when(F.count_distinct(F.nullif(F.col(c), F.lit(""))) == 1, F.max(c)).alias(f"one_{c}")
    agreed = placed.groupBy(*by).agg(*(one(c) for c in ("kind", "way", "zip")), F.collect_set("place").alias("places"))
    agreed = agreed.withColumn("one_zip", F.when(one_place("places"), F.col("one_zip"))).drop("places")
    out = rows.join(agreed, by, "left")
    for c in ("kind", "way", "zip"):
        lacks = (F.col(c) == "") & (F.col("town") == "") if c == "zip" else F.col(c) == ""
        out = out.withColumn(c, F.when(lacks, F.coalesce(f"one_{c}", F.lit(""))).otherwise(F.col(c))).drop(f"one_{c}")
    return out.join(usual, "zip", "left").select("value_id", "stands_for", *(x.split()[0] for x in _FORM.split(", ")), F.coalesce("usual", F.lit("")).alias("usual"))


def _grams(text: Column) -> Column:
    """Distinct n-grams of the words of a text, each with its borders."""
    word = lambda w: F.transform(F.sequence(F.lit(1), F.length(w) + (3 - GRAM)), lambda i: F.substring(F.concat(F.lit("^"), w, F.lit("$")), i, F.lit(GRAM)))
    return F.array_distinct(F.flatten(F.transform(F.filter(F.split(text, " "), lambda w: w != ""), word)))


def _vectors(rows: DataFrame, key: str, text: str, cosine: float) -> tuple[DataFrame, DataFrame]:
    """(key, gram) of the prefixes to index, and (key, v) of the unit vectors of weighted n-grams.

    Prefix filter: with the n-grams of a text ordered from rare to common, two texts
    of a cosine of at least ``cosine`` share one of the n-grams after whose removal
    the rest weighs less than ``cosine`` of the whole.
    """
    grams = rows.select(key, F.explode(_grams(F.col(text))).alias("gram"))
    total = rows.count()
    weights = grams.groupBy("gram").agg(F.count("*").alias("df")).select("gram", "df", F.log(F.lit(float(total + 1)) / F.col("df") + 1).alias("w"))
    weighed = cut(grams.join(weights, "gram"))
    whole = W.partitionBy(key)
    square = F.col("w") * F.col("w")
    before = F.sum(square).over(whole.orderBy("df", "gram").rowsBetween(W.unboundedPreceding, 0)) - square
    ranked = weighed.select(key, "gram", "w", F.sum(square).over(whole).alias("all"), before.alias("before"))
    prefix = ranked.filter(F.col("all") - F.col("before") >= F.col("all") * cosine * cosine * (1 - 1e-9)).select(key, "gram")
    vectors = ranked.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("gram", F.col("w") / F.sqrt("all")))).alias("v"))
    return prefix, vectors


def _cosine(a: str, b: str) -> Column:
    return F.aggregate(F.map_entries(a), F.lit(0.0), lambda acc, e: acc + e["value"] * F.coalesce(F.try_element_at(F.col(b), e["key"]), F.lit(0.0)))


def similar_names(names: DataFrame, cosine: float = NAME_COSINE) -> DataFrame:
    """(group, name_a, name_b) of the names of one group that are alike, each name with itself as well."""
    python_ready(names.sparkSession)
    distinct = names.select("name").distinct()
    prefix, vectors = _vectors(distinct, "name", "name", cosine)
    index = cut(names.join(prefix, "name"))
    a, b = (index.select("group", "gram", F.col("name").alias(f"name_{x}")) for x in "ab")
    pairs = a.join(b, ["group", "gram"]).filter(F.col("name_a") < F.col("name_b")).select("group", "name_a", "name_b").distinct()
    va, vb = (vectors.select(F.col("name").alias(f"name_{x}"), F.col("v").alias(f"v{x}")) for x in "ab")
    near = pairs.join(va, "name_a").join(vb, "name_b").filter(_cosine("va", "vb") >= cosine).select("group", "name_a", "name_b")
    close = near.filter(alike_udf("name_a", "name_b"))
    own = names.select("group", F.col("name").alias("name_a"), F.col("name").alias("name_b"))
    return cut(close.unionByName(close.select("group", F.col("name_b").alias("name_a"), F.col("name_a").alias("name_b"))).unionByName(own))


@F.pandas_udf(T.BooleanType())
def alike_udf(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([alike(x, y) for x, y in zip(a, b)], dtype=bool)


@F.pandas_udf(T.BooleanType())
def same_town(zip_a: pd.Series, zip_b: pd.Series, town_a: pd.Series, town_b: pd.Series, usual_a: pd.Series, usual_b: pd.Series) -> pd.Series:
    """Equal codes, or towns that are alike where a code is missing; an unknown place contradicts none."""

    def one(za: str, zb: str, ta: str, tb: str, ua: str, ub: str) -> bool:
        if za and zb:
            return za == zb
        if not (ta or ua) or not (tb or ub):
            return True
        return any(x and y and alike(x, y) for x in (ta, ua) for y in (tb, ub))

    return pd.Series([one(*x) for x in zip(zip_a, zip_b, town_a, town_b, usual_a, usual_b)], dtype=bool)


_FORM_PARTS = ["house", "stands_for", "name", "kind", "way", "zip", "town", "usual"]


def _blocks(forms: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(form, block) of the asking and of the answering side of the index: where two addresses can be one place.

    Of two addresses with postal codes only those of one code meet. An address
    without one asks for every town that its own may be a misspelling of; one that
    names no place asks for all.
    """
    code = F.col("zip") != ""
    towns = F.filter(F.array_distinct(F.array("town", "usual")), lambda t: t != "")
    placed = forms.select("form", "zip", F.explode(towns).alias("town"))
    distinct = placed.select(F.lit("").alias("group"), F.col("town").alias("name")).distinct()
    spelt = similar_names(distinct).select(F.col("name_a").alias("town"), F.col("name_b").alias("other"))
    by_code = forms.filter(code).select("form", F.concat(F.lit("z"), "zip").alias("block"))
    by_town = placed.select("form", F.concat(F.lit("t"), "town").alias("block"))
    asked = placed.filter(~code).join(spelt, "town").select("form", F.concat(F.lit("t"), "other").alias("block"))
    nowhere = forms.filter(~code & (F.col("town") == "") & (F.col("usual") == "")).select("form", F.lit("").alias("block"))
    anywhere = forms.select("form", F.lit("").alias("block"))
    answering = by_code.unionByName(by_town)
    if nowhere.limit(1).count():
        answering = answering.unionByName(anywhere)
    return by_code.unionByName(asked).unionByName(nowhere).distinct(), answering.distinct()


def address_links(forms: DataFrame, cosine: float = COSINE) -> DataFrame:
    """(form_a, form_b), form_a < form_b, of the distinct addresses whose vectors are near and no part of which contradicts."""
    street = F.concat_ws(" ", "stands_for", F.when(F.col("kind") != "", F.concat(F.lit("~"), F.substring_index("kind", ":", -1))), F.when(F.col("way") != "", F.concat(F.lit("+"), "way")))
    whole = F.concat_ws(" ", street, "zip", F.coalesce(F.nullif("usual", F.lit("")), "town"))
    asking, answering = _blocks(forms)
    # Under the block that stands for any place, addresses are compared without their place.
    texts = forms.select("form", "house", F.explode(F.array(F.struct(F.lit(True).alias("placed"), whole.alias("text")), F.struct(F.lit(False).alias("placed"), street.alias("text")))).alias("t"))
    texts = texts.select((F.col("form") * 2 + F.col("t.placed").cast("long")).alias("key"), "form", "house", "t.*")
    prefix, vectors = _vectors(texts, "key", "text", cosine)
    vectors = cut(vectors)
    keyed = cut(texts.select("key", "form", "house", "placed").join(prefix, "key"))
    side = lambda blocks, name: keyed.join(blocks.withColumn("placed", F.col("block") != ""), ["form", "placed"]).select(F.col("key").alias(name), F.col("form").alias(f"f{name}"), "house", "block", "gram")
    met = side(asking, "x").join(side(answering, "y"), ["house", "block", "gram"]).filter("fx <> fy").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
    va, vb = (vectors.select(F.col("key").alias(x), F.col("v").alias(f"v{x}")) for x in "ab")
    near = met.join(va, "a").join(vb, "b").filter(_cosine("va", "vb") >= cosine).select(F.expr("a div 2").alias("form_a"), F.expr("b div 2").alias("form_b")).distinct()
    pa, pb = (forms.select(*(F.col(c).alias(f"{c}_{x}") for c in ["form", *_FORM_PARTS])) for x in "ab")
    free = lambda c: (F.col(f"{c}_a") == "") | (F.col(f"{c}_b") == "") | (F.col(f"{c}_a") == F.col(f"{c}_b"))
    compared = near.join(pa, "form_a").join(pb, "form_b").filter(free("kind") & free("way"))
    named = (F.col("stands_for_a") == F.col("stands_for_b")) | alike_udf("name_a", "name_b") | alike_udf("stands_for_a", "stands_for_b")
    return compared.filter(named & same_town("zip_a", "zip_b", "town_a", "town_b", "usual_a", "usual_b")).select("form_a", "form_b")


def same_places(reports: DataFrame, cosine: float = COSINE) -> DataFrame:
    """(value_id_a, value_id_b), value_id_a < value_id_b, of the entries that name the same building."""
    rows = entries(reports)
    read_ = spread(rows.select("value").distinct()).mapInPandas(_read_batches, f"value string, {_READ}")
    rows = cut(_set_off(cut(rows.join(read_, "value"))).withColumn("site", F.coalesce("site", F.lit(""))))
    filled = cut(_filled(rows.join(_usual_names(rows), ["site", "house", "name"])))
    known = (F.col("usual") != "") & (F.col("town") != "")
    town = F.when(known & alike_udf("town", "usual"), F.col("usual")).otherwise(F.col("town"))
    named = cut(filled.withColumn("town", town).select("value_id", *_FORM_PARTS))
    forms = cut(named.groupBy(*_FORM_PARTS).agg(F.min("value_id").alias("form")))
    links = cut(address_links(forms, cosine).unionByName(forms.select(F.col("form").alias("form_a"), F.col("form").alias("form_b"))))
    of = cut(named.join(forms, _FORM_PARTS).select("value_id", "form"))
    left = of.select(F.col("form").alias("form_a"), F.col("value_id").alias("x"))
    right = of.select(F.col("form").alias("form_b"), F.col("value_id").alias("y"))
    return (
        links.join(left, "form_a")
        .join(right, "form_b")
        .filter(F.when(F.col("form_a") == F.col("form_b"), F.col("x") < F.col("y")).otherwise(F.col("x") != F.col("y")))
        .select(F.least("x", "y").alias("value_id_a"), F.greatest("x", "y").alias("value_id_b"))
    )
