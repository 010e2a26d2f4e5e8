"""Address normalisers: the reference's one golden case plus rule checks."""

from pyspark.sql import functions as F

from territoria.functions import ids, text

RAW = "ARNAUD GUEDES AMORIM 145, COELHO DA ROCHA, SAO JOAO DE MERITI - RJ, 25550-570, Brasil"
BASE = "ARNAUD GUEDES AMORIM 145, COELHO DA ROCHA, SAO JOAO DE MERITI - RJ, 25550-570"
GEO = "Arnaud Guedes Amorim 145, Coelho Da Rocha, Sao Joao De Meriti - Rj, 25550-570"


def _one(spark, col, value):
    return spark.createDataFrame([(value,)], "s string").select(col(F.col("s")).alias("o")).first()["o"]


def test_golden_case(spark):
    assert _one(spark, text.normalize_base, RAW) == BASE
    assert _one(spark, text.normalize_for_geocoding, BASE) == GEO
    key = _one(spark, text.normalize_for_cache, BASE)
    assert key == BASE and len(key) > 30 and "-" in key and "25550-570" in key


def test_title_case_like_python(spark):
    for s in ["coelho-da rocha 9de julho", "d'água são joão", "ABC def"]:
        assert _one(spark, text.title_case, s) == s.title()


def test_accents_and_keys(spark):
    assert _one(spark, text.fold_accents, "São João Ç ñ") == "Sao Joao C n"
    assert _one(spark, text.city_key, "  são paulo ") == "SAO PAULO"
    assert _one(spark, text.city_key, "   ") is None


def test_fix_encoding(spark):
    assert _one(spark, text.fix_encoding, "SÃ£o Paulo") == "São Paulo"
    assert _one(spark, text.fix_encoding, " São\x01 ") == "São"
    assert _one(spark, text.fix_encoding, "x€y") == "x€y"


def test_trailing_number(spark):
    df = spark.createDataFrame([("RUA 25 DE MARÇO",), ("AV PAULISTA, 1578",), ("Rua X 12",)], "s string")
    st, num = text.split_trailing_number(F.col("s"))
    rows = [tuple(r) for r in df.select(st, num).collect()]
    assert rows == [("RUA 25 DE MARÇO", ""), ("AV PAULISTA", "1578"), ("Rua X", "12")]


def test_money_and_cnpj(spark):
    df = spark.createDataFrame([("R$ 1.234,56",), ("1234.5",), ("abc",), ("2000000000",)], "s string")
    assert [r[0] for r in df.select(ids.parse_money_br("s")).collect()] == [1234.56, 1234.5, None, None]
    df = spark.createDataFrame([("1,23E+13",), ("",), ("12.345.678/0001-90",)], "s string")
    assert [r[0] for r in df.select(ids.clean_cnpj("s")).collect()] == ["12300000000000", "", "12345678000190"]
    assert _one(spark, ids.format_cnpj, "2.17E+13") == "21.700.000/0000-00"


def test_uuid_and_dates(spark):
    u = "6F9619FF-8B86-D011-B42D-00C04FC964FF"
    assert _one(spark, ids.canonical_uuid, " " + u + "\t") == u.lower()
    assert _one(spark, ids.canonical_uuid, "not-a-uuid") is None
    assert str(_one(spark, ids.parse_date_br, "31/12/2024")) == "2024-12-31"
    assert str(_one(spark, ids.parse_date_br, "2024-01-02")) == "2024-01-02"


def test_route_coords_and_jitter(spark):
    from territoria.functions.fmt import parse_route_coords
    from territoria.functions.geo import jitter
    df = spark.createDataFrame([("[{'lat': -23.5, 'lon': -46.6}, {'lat': null, 'lon': 1}]",),
                                ("{'lat': 1.0, 'lon': 2.0}",), ("lixo",)], "s string")
    got = [r[0] for r in df.select(parse_route_coords(F.col("s"))).collect()]
    assert [(p["lat"], p["lon"]) for p in got[0]] == [(-23.5, -46.6)]
    assert [(p["lat"], p["lon"]) for p in got[1]] == [(1.0, 2.0)]
    assert got[2] is None
    j = spark.createDataFrame([("a", 1.0, 2.0), ("b", 1.0, 2.0)], "k string, lat double, lon double")
    la, lo = jitter("k", "lat", "lon")
    rows = j.select(la.alias("a"), lo.alias("b")).collect()
    assert all(abs(r["a"] - 1.0) <= 0.002 and abs(r["b"] - 2.0) <= 0.002 for r in rows)
    assert rows == j.select(la.alias("a"), lo.alias("b")).collect()  # repeatable


def test_city_uf_centre_address_nfc_capital(spark):
    import unicodedata
    from territoria.functions.fmt import centre_address
    from territoria.operators.quality import capital_flag
    from territoria.sources import dims
    a = "Rua X 12, Centro, São Paulo - SP, 01310-100, Brasil"
    df = spark.createDataFrame([(a,)], "s string")
    city, uf, street, nonum = text.parse_city_uf(F.col("s"))
    r = df.select(city, uf, street, nonum).first()
    assert tuple(r) == ("SÃO PAULO", "SP", "Rua X 12", "Rua X")
    c = spark.createDataFrame([("Av Brasil 100A", "", "Centro", "Campinas", "sp", "")],
                              "l string, n string, b string, c string, u string, p string")
    assert c.select(centre_address("l", "n", "b", "c", "u", "p")).first()[0] == "Av Brasil - 100A - Centro - Campinas - sp"
    decomposed = unicodedata.normalize("NFD", "São")
    n = spark.createDataFrame([(decomposed,), ("abc",)], "s string")
    assert sorted(r[0] for r in text.nfc_odd_rows(n, "s").collect()) == ["São", "abc"]
    cap = spark.createDataFrame([("são paulo", "sp"), ("campinas", "SP")], "cidade string, uf string")
    flags = {r["cidade"]: r["is_capital"] for r in capital_flag(cap, dims.capitals(spark)).collect()}
    assert flags == {"são paulo": True, "campinas": False}
