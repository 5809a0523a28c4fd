"""The training-data operators on small fixtures, most against brute force or an exact round trip."""

import datetime
import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import addresses, canonical, mixing, names, pii, splitting, tokens, tries
from ledgerloom.llm import queries as q


@pytest.fixture(scope="session")
def tokenizer():
    public = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(str(public.path("byte_bpe_50k.json")))
    t.encode_special_tokens = True
    return t


TEXTS = [
    "Hello world", "", None, " ", "  \n ", "a  b   c\n\n  d", "don't we'll I'm 'tis ''s x's", "'s", " 's", "x 's", "it'S", "<|endoftext|> and <|startoftext|>", "naïve 東京 🎉👩‍👩‍👧 ١٢٣ Ⅷ", "\r\nline\r\n\tx", "\x1b[31merr\x1b[0m", "a b c　 d", "=" * 5000,
    "word " * 3000, "é" * 300, "1234567890" * 50, "x" * 3000, "tab\t\ttab", "end with space ", "end\n", "ḁ̥", "can't've", "'re're", "a'", "'", "foo' bar",
]


def test_ids(spark, tokenizer):
    rows = spark.createDataFrame([(i, t, "c", i) for i, t in enumerate(TEXTS)], "doc_id long, text string, word string, block long").repartition(3)
    got = {r["doc_id"]: list(r["ids"]) for r in tokens.encode_corpus(rows).collect()}
    assert got == {i: tokenizer.encode(t or "", add_special_tokens=False).ids for i, t in enumerate(TEXTS)}
    back = {r["doc_id"]: r["text"] for r in tokens.decode_corpus(tokens.encode_corpus(rows)).collect()}
    assert back == {i: t or "" for i, t in enumerate(TEXTS)}
    counts = {r["doc_id"]: r["n_tokens"] for r in tokens.count_tokens(rows).collect()}
    assert counts == {i: len(x) for i, x in got.items()}
    assert tokens.encode_corpus(rows.limit(0)).count() == 0 and tokens.count_tokens(rows.limit(0)).count() == 0
    twice = spark.createDataFrame([(1, "ab"), (1, "ab"), (None, "x")], "doc_id long, text string")
    assert tokens.encode_corpus(twice).count() == 3


def test_pretokens_random(tokenizer):
    r = random.Random(5)
    alphabet = "ab'srelvd  \n\t1é東.,!  🎉"
    for _ in range(300):
        t = "".join(r.choice(alphabet) for _ in range(r.randint(1, 30)))
        points = np.frombuffer(t.encode("utf-32-le"), "<u4")
        starts = tokens.pretoken_starts(points, np.array([0]))
        want = [a for _, (a, _) in tokenizer.pre_tokenizer.pre_tokenize_str(t)]
        # characters of several bytes give overlapping offsets only inside a pre-token
        assert starts.tolist() == want, t


def edits(a, b):
    d = [[i + j if i * j == 0 else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i][j] = min(d[i][j], d[i - 2][j - 2] + 1)
    return d[-1][-1]


def mistyped(r, w, letters="abcdefg"):
    i, c = r.randrange(len(w)), r.choice(letters)
    return r.choice([w[:i] + c + w[i:], w[:i] + w[i + 1 :], w[:i] + c + w[i + 1 :], w[:i] + w[i + 1 : i + 2] + w[i : i + 1] + w[i + 2 :]])


def test_trie_keys():
    r = random.Random(3)
    for letters in ("ab", "abcdefgh"):
        for n in range(3, 15):
            for _ in range(400):
                w = v = "".join(r.choice(letters) for _ in range(n))
                for _ in range(r.randint(1, 2)):
                    v = mistyped(r, v, letters) if v else v
                if v and edits(v, w) <= min(tries.errors_allowed(len(v)), tries.errors_allowed(len(w))):
                    assert set(tries.indexed_keys(w)) & tries.asking_keys(v), (v, w)
                    assert len(v) < len(w) or set(tries.indexed_keys(w)) & tries.asking_keys(v, len(v)), (v, w)


def test_trie_join(spark, monkeypatch):
    r = random.Random(2)
    words = {"weber", "wbeer", "baker", "bkaer", "stone", "sotne"}
    for w in ["".join(r.choice("abcdefg") for _ in range(r.randint(3, 14))) for _ in range(40)]:
        words |= {w, *(x for _ in range(3) if (x := mistyped(r, w))), mistyped(r, mistyped(r, w) or w)}
        words |= {w[:i] + w[i + 1] + w[i] + w[i + 2 :] for i in range(len(w) - 1)}  # an exchange at every place
    words = sorted(w for w in words if w)
    trie = tries.Trie()
    for i, w in enumerate(words):
        trie.add(w, i)
    for w in words[:30]:
        assert {(v, d) for _, v, d in trie.within(w, 2)} == {(i, e) for i, x in enumerate(words) if (e := edits(w, x)) <= 2}
    nodes = spark.createDataFrame([(b, i, [w], True, True) for b in ("b", "other") for i, w in enumerate(words)], "block string, node long, forms array<string>, indexed boolean, asking boolean")
    nodes = nodes.where("block = 'b' or node % 2 = 0").withColumn("node", F.when(F.col("block") == "b", F.col("node")).otherwise(F.col("node") + 10_000))
    least = lambda i, j: min(tries.errors_allowed(len(words[i])), tries.errors_allowed(len(words[j])))
    want = {(i, j) for i, j in itertools.permutations(range(len(words)), 2) if abs(len(words[i]) - len(words[j])) <= 2 and edits(words[i], words[j]) <= least(i, j)}
    want |= {(i + 10_000, j + 10_000) for i, j in want if i % 2 == 0 == j % 2}
    for mutual, hot in ((False, 20_000), (True, 20_000), (True, 3)):
        monkeypatch.setattr(tries, "HOT_ROWS", hot)
        assert {(x["node"], x["near"]) for x in tries.near(nodes, mutual).collect()} == want
    assert tries.near(nodes.limit(0)).count() == 0


def test_roots(spark):
    chain = spark.createDataFrame([(i, 100 - i) for i in range(40)] + [(90, 1), (91, 5)], "node long, n long")
    links = spark.createDataFrame([(i, i - 1, 1) for i in range(1, 40)] + [(i - 1, i, 1) for i in range(1, 40)] + [(90, 91, 1)], "node long, near long, distance int")
    assert {(x["node"], x["root"]) for x in names.roots(chain, links).collect()} == {(i, 0) for i in range(40)} | {(90, 91), (91, 91)}
    assert names.roots(chain.limit(0), links).count() == 0


TRADES = {"foods": "fds", "consulting": "cons", "coffee house": "coffee hse", "robotics": "rbt", "plumbing": "plumb", "textiles": "text"}
GIVEN = {"jennifer": "jen", "mohammed": "mo", "edward": "eddie", "dorothy": "dot", "patience": "pia", "yuki": "yukiko"}


def made_names(count=70, seed=3):
    """Firms and persons of made-up houses and surnames, with short forms of trades and given names that no list holds."""
    r = random.Random(seed)
    syllables = [c + v + e for c in "bdfgklmnprstvz" for v in "aeiou" for e in ("", "n", "l")]
    word = lambda k: "".join(r.choice(syllables) for _ in range(k)).title()
    groups = []
    for i in range(count):
        for trade in r.sample(sorted(TRADES), 2):
            house = f"{word(3)} {word(3)}"
            groups.append([f"{house} {trade.title()} Ltd", f"{house.upper()} {trade.upper()} LIMITED", f"{trade.title()} {house} Ltd", *([f"{house} {TRADES[trade].title()} Ltd"] if i % 2 else [])])
        for given in r.sample(sorted(GIVEN), 2):
            surname = word(4)
            groups.append([f"{given.title()} {surname}", f"{surname} {given.title()}", *([f"{surname}, {GIVEN[given].title()}"] if i % 2 else [])])
    return groups


def test_vocabulary(spark):
    rows = [(k, s) for k, s in enumerate(s for g in made_names() for s in g)]
    words = spark.createDataFrame(rows, "id long, spelling string").selectExpr("'vendor_name' as field", "id", "1L as n", "spelling").mapInArrow(names._read, names._WORDS)
    got = {(x["run"], x["role"], tuple(x["values"])) for x in names.vocabulary(words).collect()}
    want = {(w, "trade", (t,)) for t, s in TRADES.items() for w in (t, s)} | {(w, "given", (g,)) for g, s in GIVEN.items() for w in (g, s)}
    want = {(names.plain(a), role, tuple(names.plain(v) for v in vs)) for a, role, vs in want}
    assert want <= got and all(" " not in run and any(run in w.split() for w, _, _ in want) for run, _, _ in got - want)
    assert names.vocabulary(words.limit(0)).count() == 0


def test_names(spark):
    made = made_names()
    house, surname = made[0][0].split()[:2], made[2][0].split()[1]
    trade = " ".join(made[0][0].split()[2:-1])
    given = made[2][0].split()[0]
    made[0] += [f"{house[1]}, {house[0]} {trade} Ltd", f"M/s {house[0]} {house[1]} {trade} Ltd *", f"{house[0]} {house[1]} Ltd", f"{house[0][:3]}{house[0][4]}{house[0][3]}{house[0][5:]} {house[1]} {trade} Ltd"]
    made[2] += [f"MX {given.upper()} {surname.upper()}", f"{given[0]}. B. {surname}"]
    made += [[f"{house[0]} {house[1]} Logging AG, Branch 7", f"{house[0]} {house[1]} Logging A.G."], [f"Zebedee {surname}"], ["-"], ["walk-in"], ["n/a"], [""]]
    flat = [(i, s) for i, g in enumerate(made) for s in g]
    rows = [(k, s, s, "clash", k) for k, (_, s) in enumerate(flat)]
    inv = spark.createDataFrame([*rows, *rows, (9000, None, None, None, 1)], "record_id long, vendor_name string, customer_name string, id string, n long")
    rec = spark.createDataFrame([(1, None), (2, "x" * 4000)], "record_id long, merchant_name string")
    got = {(r["field"], r["id_a"], r["id_b"]) for r in names.same_names(inv, rec).collect()}
    want = {(a, b) for (a, (g, s)), (b, (h, _)) in itertools.combinations(enumerate(flat), 2) if g == h and len(s) > 8}
    assert got == {(f, a, b) for f in ("vendor_name", "customer_name") for a, b in want}
    assert names.same_names(inv.limit(0), rec.limit(0)).count() == 0


def test_unlisted_names(spark):
    groups = [
        ["Acme Robotics Ltd", "Acme Robotcs Ltd", "Robotics Acme Ltd", "Acme Robotics", "ACME ROBOTICS LIMITED"], ["Zoe Harker", "Harker, Zoe", "Zoe Harkr"], ["Joe Harker"],
        ["Acme Rockets Ltd", "Rockets Acme Ltd"], ["Acme Rockets GmbH", "Acme Rokets GmbH"], ["Acme Rockets"],
        ["Quadro Lumen Vexil Tandor Ltd", "Tandor Vexil Lumen Quadro Ltd", "Vexil Xuadro Tandor Lumem Ltd"], ["Brosel Kintar Omvel Padrun Foods AG", "Padrun Omvem Brosel Kintar Foods AG"],
    ]
    flat = [(i, s) for i, g in enumerate(groups) for s in g]
    inv = spark.createDataFrame([(k, s, None) for k, (_, s) in enumerate(flat)], "record_id long, vendor_name string, customer_name string")
    rec = spark.createDataFrame([], "record_id long, merchant_name string")
    got = {(r["id_a"], r["id_b"]) for r in names.same_names(inv, rec).collect()}
    assert got == {(a, b) for (a, (g, _)), (b, (h, _)) in itertools.combinations(enumerate(flat), 2) if g == h}
    assert names.same_words(["old", "mill"], ["mill", "old"]) and not names.same_words(["zoe", "harker"], ["joe", "harker"])


def test_likelihood_ratio(spark):
    got = spark.sql(f"SELECT {names.likelihood_ratio('a', 'b', 'c', 'd')} AS g FROM VALUES (30L, 40L, 50L, 1000L), (2L, 40L, 50L, 1000L), (5L, 5L, 5L, 100L) AS t(a, b, c, d)").collect()
    cells = [(30, 40, 50, 1000), None, (5, 5, 5, 100)]
    for x, cell in zip(got, cells, strict=True):
        want = 0.0
        if cell:
            a, b, c, d = cell
            for o, m, n in ((a, b, c), (b - a, b, d - c), (c - a, d - b, c), (d - b - c + a, d - b, d - c)):
                want += 2 * o * np.log(o * d / (m * n)) if o else 0.0
        assert abs(x["g"] - want) < 1e-6


def test_addresses(spark):
    streets = ["Kibimpoji", "Menjulrennu", "Tovedenbet", "Rardeijegul", "Hansolidur", "Vemarokten"]
    groups = []
    for i, s in enumerate(streets):
        n, code = 38 + i, 28520 + i
        groups.append([f"{n}c {s} Street, Unit 4, Mount Tarrow, QN {code}", f"{n} C {s} St., Mt Tarrow, QN {code}", f"MOUNT TARROW, QN {code}, {n}C {s.upper()} STREET", f"No. {n}c {s} Street\nFloor 2\n{code}", f"{s} Street {n}c, Mount Tarrow"])
        groups.append([f"{n} {s} Street, Mount Tarrow, QN {code}", f"{n} {s[:-1]} Street, Mount Tarrow, QN, Velland"])
        groups.append([f"{n} {s} Road, Mount Tarrow, QN {code}"])
    groups += [["12 Old Mill Road, Mount Tarrow, QN 28520", "12 Old Mill Rd, Mount Tarrow", "Old Mill Road 12, Mount Tarrow"], ["12 New Mill Road, Mount Tarrow, QN 28520"], ["rue de la Paix 12, Hagenrode", "12, rue de la Paix, 41255 Hagenrode"], ["12 rue de la Bastille, 41255 Hagenrode"]]
    groups += [["Sentupazetplatz 159, 41255 Hagenrode", "Sentupazetpl. Nr. 159, 41255 Hagenrode"], ["-"], [""], ["Somewhere"]]
    flat = [(i, s) for i, g in enumerate(groups) for s in g]
    inv = spark.createDataFrame([(k, s, None, "x") for k, (_, s) in enumerate(flat)] + [(900, None, None, "x")], "record_id long, vendor_address string, customer_address string, town string")
    rec = spark.createDataFrame([(1, "x " * 3000)], "record_id long, merchant_address string")
    got = {(r["id_a"], r["id_b"]) for r in addresses.same_addresses(inv, rec).collect()}
    want = {(a, b) for (a, (g, _)), (b, (h, _)) in itertools.combinations(enumerate(flat), 2) if g == h}
    assert got == want
    assert addresses.same_addresses(inv.limit(0), rec.limit(0)).count() == 0


def test_small_towns_of_a_front(spark):
    groups = [[f"{n} Kibimpoji Street, Hagenrode, QN {41200 + n}", f"{n} Kibimpoji Street, Hagenrode"] for n in range(10, 60)]
    groups += [[f"{n} Kibimpoji Street, Vintburg, QN 41299", f"{n} Kibimpoji Street, Vintburg"] for n in (11, 12)]
    groups[3].append("13 Kibimpoji Street, Hagenrdoe, QN 41288")
    flat = [(i, s) for i, g in enumerate(groups) for s in g]
    inv = spark.createDataFrame([(k, s, None) for k, (_, s) in enumerate(flat)], "record_id long, vendor_address string, customer_address string")
    rec = spark.createDataFrame([], "record_id long, merchant_address string")
    got = {(r["id_a"], r["id_b"]) for r in addresses.same_addresses(inv, rec).collect()}
    assert got == {(a, b) for (a, (g, _)), (b, (h, _)) in itertools.combinations(enumerate(flat), 2) if g == h}


def test_canonical(spark):
    methods = spark.createDataFrame([("cash", "Cash", ["Bargeld"]), ("credit_card", "Credit card", ["Kreditkarte", "carte de crédit"]), ("debit_card", "Debit card", ["carte de débit"]), ("cheque", "Cheque", None)], "code string, label string, local_names array<string>")
    cases = [("CASH.", "cash"), ("paid: Barge1d", "cash"), ("bar", "cash"), ("barter", "UNMATCHED"), ("carte de crdéit", "credit_card"), ("carte de débti", "debit_card"), ("credit crd ****4256", "credit_card"), ("", "UNMATCHED"), ("???", "UNMATCHED"), ("z" * 3000, "UNMATCHED"), ("house account 9", "UNMATCHED"), ("gift card", "UNMATCHED")]
    rec = spark.createDataFrame([(i, s, "c") for i, (s, _) in enumerate(cases)] + [(99, None, "c")], "record_id long, payment_method string, code string")
    assert {r["record_id"]: r["canonical"] for r in canonical.payment_codes(rec, methods).collect()} == {i: w for i, (_, w) in enumerate(cases)}
    currencies = spark.createDataFrame([("USD", "US dollar", "$", 2, 1.0, ["dollars"]), ("CAD", "Canadian dollar", "$", 2, 0.7, None), ("SEK", "Swedish krona", "kr", 2, 0.1, None), ("NOK", "Norwegian krone", "kr", 2, 0.1, None), ("EUR", "Euro", "€", 2, 1.1, None)], "code string, label string, symbol string, minor_digits int, usd_per_unit double, local_names array<string>")
    systems = spark.createDataFrame([("ca", "CAD"), ("none", None)], "source_system string, default_currency string")
    cases = [("ca", "$", "CAD"), ("none", "$", "UNMATCHED"), ("none", "€ EUR", "EUR"), ("ca", "öre", "SEK"), ("ca", "øre", "NOK"), ("ca", "Tsd. EUR", "EUR"), ("ca", "US do1lar", "USD"), ("ca", "Kronthaler", "UNMATCHED"), ("ca", "E U R", "EUR"), ("ca", "cents", "CAD"), ("ca", "", "UNMATCHED"), ("zz", "kr", "UNMATCHED")]
    inv = spark.createDataFrame([(i, s, c, "x") for i, (s, c, _) in enumerate(cases)] + [(99, "ca", None, "x")], "record_id long, source_system string, currency string, stripped string")
    assert {r["record_id"]: r["canonical"] for r in canonical.currency_codes(inv, systems, currencies).collect()} == {i: w for i, (_, _, w) in enumerate(cases)}
    assert canonical.canonical(inv.limit(0), rec.limit(0), systems, currencies, methods).count() == 0


PLACES = pii.Gazetteer(["mount tarrow", "hagenrode"], ["mount tarrow", "hagenrode"], ["velland"], ["dot", "wilhelmina", "robert", "edward"], ["asked", "signed"], ["trading", "foods"])
TEXT = "Signed M. Lilkorkorjar / SSN: 941-47-1050 / +1-555-016-7010 ext. 32\nShip to 38c Kibimpoji Street, Unit 4, Mount Tarrow, QN 28526, Velland; ring 020 7946 0789.\ncc Dot Kubei-Penfim and Hulne, Wilhelmina; mail <fupan_26 at box[.]invalid>. Lot 132-54-8216 inspected. Morris chair parts. Rack position 8.32.21.87\nBill to: Tole Nilgi Trading Ltd"


def test_mentions(spark):
    rows = spark.createDataFrame([("notes", 1, 0, TEXT), ("notes", 2, 0, None), ("notes", 3, 0, ""), ("notes", 4, 0, "x" * 20000), ("notes", 5, 0, TEXT)], "field string, row_id long, result_no int, text string")
    found = pii.mentions(rows, PLACES).collect()
    want = {("NAME", "M. Lilkorkorjar"), ("ID", "941-47-1050"), ("PHONE", "+1-555-016-7010 ext. 32"), ("ADDRESS", "38c Kibimpoji Street, Unit 4, Mount Tarrow, QN 28526, Velland"), ("PHONE", "020 7946 0789"), ("NAME", "Dot Kubei-Penfim"), ("NAME", "Hulne, Wilhelmina"), ("EMAIL", "fupan_26 at box[.]invalid")}
    assert {(r["pii_type"], r["value"]) for r in found if r["row_id"] == 1} == want and {r["row_id"] for r in found} == {1, 5}
    clean = {r["row_id"]: r["text"] for r in pii.redacted(rows, PLACES).collect()}
    assert clean[1].startswith("Signed [NAME] / SSN: [ID] / [PHONE]\nShip to [ADDRESS]; ring [PHONE].") and clean[2] is None and clean[3] == ""
    assert pii.mentions(rows.limit(0), PLACES).count() == 0


def test_field_sums():
    r = random.Random(1)
    for _ in range(20):
        spans = []
        for _ in range(7):
            b = r.randint(0, 8)
            spans.append((b, b + r.randint(1, 4), "T", r.uniform(-2, 2)))
        total, each = 0.0, [0.0] * len(spans)
        for k in range(len(spans) + 1):
            for some in itertools.combinations(range(len(spans)), k):
                ordered = sorted(spans[i][:2] for i in some)
                if all(a[1] <= b[0] for a, b in itertools.pairwise(ordered)):
                    w = np.exp(sum(spans[i][3] for i in some))
                    total += w
                    for i in some:
                        each[i] += w
        assert np.allclose(pii.marginals(spans), np.array(each) / total)


def spoken(count, given, seed):
    """Labelled notes with names of the given names; half the surroundings are in no list of the module."""
    r = random.Random(seed)
    word = lambda k: "".join(r.choice("bdfgklmnprstvz") + r.choice("aeiou") for _ in range(k)).title()
    forms = ["{} asked us to wait.", "Collected by {} at the gate.", "We spoke with {} about line 2.", "The keys are with {}.", "Goods of {F} Foods were late.", "From: {F} Trading Ltd\nTOTAL 12.00", "Payable in Canadian Dollars.", "Parts for {T} stock.", "{P} Papier                1        20.00\nTOTAL 1", "Order {P} Stunde again"]
    out = []
    for _ in range(count):
        form = r.choice(forms)
        fill = f"{r.choice(given)} {word(3)}" if "{}" in form else ""
        text = form.replace("{}", fill).replace("{F}", word(2)).replace("{T}", "Mount Tarrow").replace("{P}", r.choice(["XL", "LED"]))
        out.append((text, [(at, at + len(fill), "NAME")] if fill and (at := text.find(fill)) >= 0 else []))
    return out


def accuracy(texts, weights):
    right = given = told = 0
    for text, gold in texts:
        got = set(pii.best(text, PLACES, weights))
        right, given, told = right + len(got & set(gold)), given + len(gold), told + len(got)
    return right / given, right / max(told, 1)


def test_held_out_accuracy():
    weights = pii.fit(spoken(400, ["Robert", "Edward", "Wilhelmina"], 1), PLACES)
    unseen = spoken(200, ["Jennifer", "Mohammed", "Yuki"], 2)  # given names that no list holds
    recall, precision = accuracy(unseen, pii.PRIOR)
    assert recall < 0.5  # without the fit they are not found
    recall, precision = accuracy(unseen, weights)
    assert recall > 0.95 and precision > 0.95
    for text, value in (("Served by Robert Ashworth   12.00", "Robert Ashworth"), ("bob.smith@mail.example   12.00", "bob.smith@mail.example"), ("12 Mill Grove, Mount Tarrow", "12 Mill Grove, Mount Tarrow"), ("Tel. 01.99.00.12.34   4.50", "01.99.00.12.34"), ("Steuer-ID: 12 345 678 901   1.00", "12 345 678 901")):
        assert value in {text[b:e] for b, e, _ in pii.best(text, PLACES, pii.PRIOR)}, text


def test_found(spark):
    """What the columns teach, and the labels of the fit."""
    made = made_names(40)
    n = len(made)
    inv = spark.createDataFrame([(k, k, g[0], g[-1], f"{10 + k % 80} Kibimpoji Street, Mount Tarrow, QN 285{k % 90 + 10}", None, None, None, None, "USD", f"Collected by {g[0]} at the gate." if k % 4 > 1 else "Payment in 30 days of the invoice date.") for k, g in enumerate(made)], "record_id long, harvest_id long, vendor_name string, customer_name string, vendor_address string, customer_address string, vendor_email string, customer_email string, customer_phone string, currency string, notes string")
    rec = spark.createDataFrame([], "record_id long, harvest_id long, merchant_name string, merchant_address string, payment_method string")
    pages = spark.createDataFrame([(k, [(f"FACTURE 1\n{10 + k % 80} Kibimpoji Street, Mount Tarrow, QN 285{k % 90 + 10}\n{'Collected by Zoe Harker at the gate.' if k % 20 == 0 else 'Thank you.'}\nTOTAL 12.00",)]) for k in range(n)] + [(n, None), (n + 1, [(None,)])], "harvest_id long, extraction_results array<struct<raw_text:string>>")
    got = {(x["field"], x["row_id"], x["pii_type"], x["value"]) for x in pii.found(inv, rec, pages).collect()}
    for k, g in enumerate(made):
        if k % 4 > 1:
            assert ("notes", k, "NAME", g[0]) in got
        assert k % 20 or ("raw_text", k, "NAME", "Zoe Harker") in got
        assert ("raw_text", k, "ADDRESS", f"{10 + k % 80} Kibimpoji Street, Mount Tarrow, QN 285{k % 90 + 10}") in got
    assert pii.found(inv.limit(0), rec, pages.limit(0)).count() == 0


def corpus(spark):
    r = random.Random(4)
    rows = []
    for i in range(400):
        s = r.choice(["a", "a", "a", "A ", "b", "c", None, "other"])
        rows.append((i, None if i % 50 == 0 else "" if i % 51 == 0 else "some words of a text " * r.randint(1, 40), s))
    return spark.createDataFrame(rows, "doc_id long, text string, source string")


def test_mixing(spark):
    targets = spark.createDataFrame([("a", 0.3, 1), ("b", 0.3, 3), ("c", 0.38, 4), ("empty", 0.02, 2)], "source string, target_share double, max_repeats int")
    docs = corpus(spark)
    mix = mixing.mixed(docs, targets)
    rows = mix.collect()
    assert len(rows) == 400 and all(r["copies"] <= {"a": 1, "b": 3, "c": 4}.get(r["source"], 0) for r in rows)
    whole = sum(r["n_tokens"] for r in rows)
    took = sum(r["n_tokens"] * r["copies"] for r in rows)
    assert abs(took / whole - 1) < 0.05
    share = {r["source"]: r for r in mixing.report(mix, targets).collect()}
    for s, t in (("a", 0.3), ("b", 0.3), ("c", 0.38)):
        assert abs(share[s]["reached_share"] - t / 0.98) < 0.02
    assert share["empty"]["reached_share"] == 0 and share["other"]["tokens_after"] == 0
    assert mixing.budgets({"a": 50.0, "b": 50.0}, {"a": 0.5, "b": 0.5}, {"a": 1.0, "b": 0.4}) == {"b": 20.0, "a": 50.0}
    assert mixing.mixed(docs.limit(0), targets).count() == 0


def test_mixing_tilts(spark):
    r = random.Random(6)
    sizes = {s: [0, *(r.randint(1, 9) ** r.randint(1, 4) for _ in range(300))] for s in ("down", "up", "near_cap", "full", "same")}
    docs = spark.createDataFrame([(s, t, ts.count(t)) for s, ts in sizes.items() for t in set(ts)], "key string, n_tokens long, n long")
    part = {"down": 0.01, "up": 2.0, "near_cap": 3.99, "full": 4.0, "same": 1.0}
    goal = {s: part[s] * sum(ts) for s, ts in sizes.items()}
    state, steps = mixing.tilt(docs, goal, dict.fromkeys(sizes, 4.0))
    assert steps > 1 and state["full"][0] is None
    for s, ts in sizes.items():
        b, mean = state[s]
        rates = [4.0 if b is None else 4.0 if b * t / mean > 2 else min(4.0, np.exp(b * t / mean)) for t in ts]
        assert abs(sum(w * t for w, t in zip(rates, ts, strict=True)) / goal[s] - 1) < 1e-5
        assert (len({round(w, 9) for w in rates}) > 5) == (s not in ("full", "same"))
    # the rates of documents follow their number of tokens
    targets = spark.createDataFrame([("a", 0.3, 1), ("b", 0.3, 3), ("c", 0.4, 4)], "source string, target_share double, max_repeats int")
    rows = [x for x in mixing.mixed(corpus(spark), targets).collect() if x["source"] == "b" and x["n_tokens"] > 0]
    assert len({x["rate"] for x in rows}) == len({x["n_tokens"] for x in rows}) > 5


def test_splitting(spark, tokenizer):
    r = random.Random(8)
    texts = [None, "", "short", "line of words\n" * 400, "x" * 9000, "=" * 9000, "a b\n\n  c" * 900, "".join(r.choice("ab \n\n.,'é東🎉1") for _ in range(6000)), "word " * 2000, "\n" * 5000, " " * 5000, "📊" * 1500]
    cells = [[{"end_char": len(t) // 3}, {"end_char": None}, {"end_char": len(t)}] if t else None for t in texts]
    docs = spark.createDataFrame([(i, t, c, "clash") for i, (t, c) in enumerate(zip(texts, cells, strict=True))], "doc_id long, text string, cells array<struct<end_char:long>>, limit_name string")
    rules = [("tiny", 4, 0), ("close", 12, 8), ("odd", 50, 30), ("small", 64, 8), ("large", 512, 0)]
    limits = spark.createDataFrame(rules, "limit_name string, max_tokens int, overlap_tokens int")
    pieces = splitting.split(docs, limits).collect()
    size = lambda t: len(tokenizer.encode(t, add_special_tokens=False).ids)
    for (name, most, overlap), (i, t) in itertools.product(rules, enumerate(texts)):
        own = sorted((p for p in pieces if p["doc_id"] == i and p["limit_name"] == name), key=lambda p: p["piece_no"])
        assert bool(own) or not t or size(t) <= most
        at = 0
        for n, p in enumerate(own):
            assert p["piece_no"] == n + 1 and p["text"] == t[p["start_char"] : p["end_char"]] and size(p["text"]) <= most
            assert p["start_char"] <= at < p["end_char"] and size(t[p["start_char"] : at]) <= overlap + 1
            at = p["end_char"]
        assert not own or at == len(t)
    lines = [p for p in pieces if p["doc_id"] == 3]
    assert all(p["text"].endswith("\n") or p["end_char"] == len(texts[3]) // 3 for p in lines if p["limit_name"] in ("small", "large"))
    assert splitting.split(docs.limit(0), limits).count() == 0
    with pytest.raises(ValueError, match="overlap"):
        splitting.split(docs, spark.createDataFrame([("bad", 64, 61)], limits.schema))


def test_queries_have_names():
    assert [n for n in q.queries() if n.startswith("p8")] == ["p8_ids"] and set(q.oracle_sql()) <= set(q.queries())
    assert datetime.date(2024, 1, 1) and F is not None
