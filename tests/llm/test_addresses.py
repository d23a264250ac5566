import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from siteloom.llm import addresses as A

SAME = [
    "194 E. Lorimiro Pkwy., Braafendale, OH 10002", "194 East Lorimiro Parkway\nUnit 4\nBraafendale, Ohio 10002-1524", "Braafendale, OH 10002; 194 E Lorimiro", "Acme Shop - No. 194 East Lormiro PKWY - Braafendale", "194 Lorimiro Parkway, 10002, USA",
]
OTHER = ["196 E Lorimiro Pkwy, Braafendale, OH 10002", "194 W Lorimiro Pkwy, Braafendale, OH 10002", "194 E Lorimiro Court, Braafendale, OH 10002", "194 E Lorimiro Pkwy, Lunixneldale, TX 10600", "194 E Torunkor Pkwy, Braafendale, OH 10002"]
REPORT = "site string, field string, values array<string>, value_ids array<long>, form string, n long"


def pairs(spark, values, field="full_address"):
    rows = [(f"s{k}", field, [v], [k], "x", 1) for k, v in enumerate(values)]
    return {tuple(r) for r in A.same_places(spark.createDataFrame(rows, REPORT)).collect()}


def test_ways_of_writing_and_details(spark):
    got = pairs(spark, SAME + OTHER)
    want = {(a, b) for a in range(len(SAME)) for b in range(a + 1, len(SAME))}
    assert want <= got and not {p for p in got if p[0] in (0, 1, 3) and p[1] >= len(SAME)}


def test_german_and_french(spark):
    german = ["Mühlweg 5, 10498 Adorf", "Muehl-Weg Nr. 5, D-10498 Adorf", "10498 Adorf, MÜHL WEG 5", "Mühlstr. 5, 10498 Adorf", "Mühlstraße 5, 3. Etage, 10498 Adorf"]
    french = ["1890, bd de Chênes Ildun - 10245 Zanix", "1890 Boulevard des Chenes Ildun, bât. 4, F-10245 Zanix, France", "1890 rue des Chênes Ildun, 10245 Zanix"]
    assert pairs(spark, german) == {(0, 1), (0, 2), (1, 2), (3, 4)}
    assert pairs(spark, french) == {(0, 1)}


def test_defined_results(spark):
    rows = [("a", "full_address", None, None, "x", 1), ("a", "full_address", [], [], "x", 1), ("a", "full_address", [None, "", "no number", "5 Elm St, Adale"], [1, 2, 3, 4], "x", 1), (None, "full_address", ["5 Elm Street, Adale", "extra"], [5], "x", 1), ("a", "phone", ["5 Elm St, Adale"], [6], "x", 1), ("a", "full_address", ["5 Elm St, Adale"], [4], "x", 1)]
    df = spark.createDataFrame(rows, REPORT)
    assert {tuple(r) for r in A.same_places(df).collect()} == {(4, 5)}
    assert A.same_places(df.limit(0)).count() == 0


@settings(max_examples=80, deadline=None)
@given(st.text(max_size=80))
def test_reading_never_fails(value):
    A.read(value)


@pytest.mark.parametrize(("a", "b", "n"), [("abc", "abc", 0), ("abcd", "abdc", 1), ("abcdef", "abdf", 2), ("kitten", "sitting", 3), ("a", "bcdef", 3)])
def test_edits(a, b, n):
    assert A.edits(a, b) == n


def test_names_against_brute_force(spark):
    names = ["orlumhol", "orulmhol", "orlumol", "orlumhhol", "torunkor", "torunkr", "selon", "seron", "xy", "elm", "elk"]
    df = spark.createDataFrame([("1", n) for n in names] + [("2", "orlumhol")], "group string, name string")
    got = {(r.name_a, r.name_b) for r in A.similar_names(df).collect() if r.name_a < r.name_b}
    assert got == {(a, b) for a in names for b in names if a < b and A.alike(a, b)}


def test_cosine_of_whole_addresses_against_brute_force(spark):
    """The prefix filter loses no pair of the same house number and place that reaches the cosine."""
    values = [f"{h} {n} {k}, {t}" for h in (5, 7) for n in ("Orlumhol", "Orlumhool", "Torunkor") for k in ("St", "Ave") for t in ("Adale, OH 10002", "Adale, OH", "OH 10002", "Befield, OH 10020")]
    links = {(values[a], values[b]) for a, b in pairs(spark, values)}
    read = {v: A.read(v) for v in values}

    def same(a, b):
        x, y = read[a], read[b]
        place = x["zip"] == y["zip"] if x["zip"] and y["zip"] else (x["zip"] or x["town"]) in ("10002", "adale") and (y["zip"] or y["town"]) in ("10002", "adale")
        return x["house"] == y["house"] and x["kind"] == y["kind"] and A.alike(x["name"], y["name"]) and place

    assert links == {(a, b) for i, a in enumerate(values) for b in values[i + 1 :] if same(a, b)}


def test_long_numbers_long_and_short_names(spark):
    cases = [
        ("12345 Main St, Springfield, IL 62701", "12345 Main Street, Springfield, IL 62701", True),
        ("5 rue Jean Baptiste Clément, 75018 Paris", "5 rue Jean Baptiste Colbert, 75018 Paris", False),
        ("6 Calle Ocho, Miami, FL 33135", "6 Calle Luna, Miami, FL 33135", False),
        ("7 Old Mill Pond Creek View Rd, Miami, FL 33135", "7 Old Mill Pond Forest View Rd, Miami, FL 33135", False),
        ("8 Elm St, Salem, MA 01970", "8 Elk St, Salem, MA 01970", False),
        ("Holorbrastr. 12346, 10253 Lunaulmgate", "10253 Lunaulmgate, Holorbrastraße 12346", True),
        ("9 Calle Ocho, Miami, FL 33135", "9 Calle Ocho, Fl. 3, Miami, Florida 33135-1234", True),
    ]
    got = pairs(spark, [x for a, b, _ in cases for x in (a, b)])
    assert got == {(2 * k, 2 * k + 1) for k, (_, _, one) in enumerate(cases) if one}


def test_parts_come_from_the_same_street_only(spark):
    rows = [("h", "full_address", ["12 Oak St, Xaville", "12 Elm Ave, 10010 Yerton"], [0, 1], "x", 1), ("k", "full_address", ["12 Oak St, 10020 Xaville"], [2], "x", 1)]
    assert {tuple(r) for r in A.same_places(spark.createDataFrame(rows, REPORT)).collect()} == {(0, 2)}


def test_a_filled_code_does_not_outvote_a_town_and_an_unknown_place_is_compatible(spark):
    rows = [("h", "full_address", ["12 Oak St, Xaville", "12 Oak St, 10010 Yerton", "12 Oak St"], [0, 1, 2], "x", 1), ("k", "full_address", ["12 Oak St, 10020 Xaville"], [3], "x", 1)]
    assert {tuple(r) for r in A.same_places(spark.createDataFrame(rows, REPORT)).collect()} == {(0, 2), (0, 3), (1, 2), (2, 3)}


def test_names_are_whole_and_towns_are_cut_off_them(spark):
    values = ["16 rue des Fenoholley, 10465 Novofengrove", "16 rue des Fenoholley Novofengrove", "9 rue de la Porte Saint Martin, 10020 Xaville", "9 rue de la Porte Saint Denis, 10020 Xaville", "7 Oak Hill Ave, Xaville, OH 10020", "7 Oak Hill, Xaville, OH 10020"]
    assert pairs(spark, values) == {(0, 1), (4, 5)}


def test_names_alike_to_one_that_stands_for_another(spark):
    t, a, b = "abcdefghij", "abcdefghxy", "abcdefvwxy"  # b is more frequent than a, t and b are not alike
    assert A.alike(t, a) and A.alike(a, b) and not A.alike(t, b)
    got = pairs(spark, [f"12 {n} St, Xaville, OH 10020" for n in (t, a, b, b)])
    assert got == {(0, 1), (1, 2), (1, 3), (2, 3)}
