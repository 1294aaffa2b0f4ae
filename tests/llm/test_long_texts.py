"""Texts that make a careless search stall or overflow, and the same rules by a slow reference."""

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from loomgraph.llm import langid, licenses, spaced, surrogates


def docs_of(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


# -- licences


def plain_rules():
    """The rules over words without numbers."""
    for label, priority, strength, keyword, pattern in licenses.rules():
        bare = pattern.removeprefix(" (?:").removesuffix(f"){licenses._NUMBER}(?= )")
        bare = bare.replace(f"(?:{licenses._NUMBER} )?", " ?").replace(f"{licenses._NUMBER} ", " ")
        yield label, priority, strength, keyword, re.compile(f" (?:{bare})(?= )")


def slow_scan(text, rules):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text))
    norm = " " + " ".join(words) + " "
    found = []
    for order, (label, priority, _, keyword, pattern) in enumerate(rules):
        if keyword in norm:
            found += [(m.start(), m.end(), priority, order, label) for m in pattern.finditer(norm)]

    def beaten(d):
        return any(
            e[0] <= d[0] and e[1] >= d[1] and (e[2] > d[2] or (e[2] == d[2] and (e[1] - e[0] > d[1] - d[0] or e[3] < d[3]))) for e in found
        )

    kept = [d for d in found if not beaten(d)]
    return sorted((norm[: a].count(" "), norm[a:b].count(" "), label, priority) for a, b, priority, _, label in kept)


def test_detections_are_those_of_a_slow_scan(spark):
    rng = random.Random(3)
    parts = [
        "Licensed under the Apache License, Version 2.0", "SPDX-License-Identifier: MIT", "GNU General Public License v2", "GPLv3", "MIT license", "CC BY-SA 4.0",
        "Creative Commons Attribution-ShareAlike License", "either version 3 of the License, or (at your option) any later version", "released under the terms of the MIT license",
        "Neither the name of Big Corp. nor its people may be used to endorse or promote products", "all rights reserved", "under", "license", "the", "version 2.0", "BSD", "öffentlich",
        "Mozilla Public License 2.0", "lesser general public license version 2.1", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software",
    ]
    texts = [" ".join(rng.choices(parts, k=rng.randint(1, 14))) for _ in range(60)] + ["", " - "] + [" ".join(["Apache License 2.0, GPLv2"] * 300)]
    rules = list(plain_rules())
    got = {r["doc_id"]: sorted((d["word"], d["n_words"], d["label"], d["priority"]) for d in r["detections"]) for r in licenses.scan(docs_of(spark, texts)).collect()}
    want = {k: slow_scan(t, rules) for k, t in enumerate(texts)}
    assert got == want and sum(map(len, want.values())) > 500


def test_a_megabyte_of_licences_is_scanned_in_seconds(spark):
    texts = ["licensed under the apache license version 2 0 " * 22_000, "mit license, gpl, " * 55_000]
    began = time.time()
    rows = sorted(licenses.scan(docs_of(spark, texts)).select("doc_id", "n_base", "labels", F.size("detections").alias("n")).collect())
    assert rows[0]["n"] == rows[0]["n_base"] == 22_000 and rows[1]["n_base"] == 55_000
    assert time.time() - began < 60


# -- personal data


def valid_iban(text):
    text = text.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in text[4:] + text[:4])) % 97 == 1


def valid_card(text):
    digits = [int(c) for c in text if c.isdigit()][::-1]
    return sum(d if k % 2 == 0 else 2 * d - 9 * (d > 4) for k, d in enumerate(digits)) % 10 == 0


def test_surrogates_keep_their_type(spark):
    rng = random.Random(8)
    digits = lambda n: "".join(rng.choices("0123456789", k=n))
    many = 40
    texts = {
        "iban": [f"DE{digits(2)} {digits(4)} {digits(4)} {digits(4)} {digits(4)} {digits(2)}" for _ in range(many)] + [f"GB{digits(2)}NWBK{digits(14)}" for _ in range(many)],
        "amex": [f"3782 {digits(6)} {digits(5)}" for _ in range(many)],
        "visa": [f"4{digits(3)}-{digits(4)}-{digits(4)}-{digits(4)}" for _ in range(many)],
        "private": [f"192.168.{rng.randrange(256)}.{rng.randrange(256)}" for _ in range(many)] + ["172.20.1.9", "10.0.0.3"],
        "public": [f"{rng.randrange(20, 100)}.{rng.randrange(256)}.7.{rng.randrange(256)}" for _ in range(many)],
        "mail": [f"{x}.{y}{n}@mail.example.net" for x, y, n in zip(rng.choices(["jane", "li", "bob"], k=many), rng.choices(["roe", "doe"], k=many), range(many), strict=True)],
        "key": [f"token={rng.getrandbits(128):032x}" for _ in range(many)],
        "ssn": [f"{digits(3)}-{digits(2)}-{digits(4)}" for _ in range(many)],
    }
    flat = [(kind, t) for kind, ts in texts.items() for t in ts]
    rows = surrogates.replace(docs_of(spark, [f"see {t} !" for _, t in flat])).collect()
    got = {r["doc_id"]: r["text"].removeprefix("see ").removesuffix(" !") for r in rows}
    ips = __import__("ipaddress").ip_address
    for k, (kind, before) in enumerate(flat):
        after = got[k]
        assert after != before and rows[0]["n_entities"] == 1
        if kind not in ("mail", "private", "public"):  # the same layout: digits for digits, letters for letters
            shape = lambda t: re.sub("[0-9]", "0", re.sub("[A-Z]", "A", t))
            assert kind == "key" or shape(after) == shape(before), (before, after)
        if kind == "iban":
            assert after[:2] == before[:2] and valid_iban(after)
        elif kind in ("amex", "visa"):
            assert valid_card(after) and after[:2] == before[:2]
        elif kind == "private":
            assert ips(after).is_private
        elif kind == "public":
            assert ips(after).is_reserved
        elif kind == "mail":
            assert re.fullmatch(r"[a-z]+\.[a-z]+\d+@[a-z]+\.example\.org", after) and len(after.split("@")[0]) == len(before.split("@")[0])
        elif kind == "key":
            assert re.fullmatch("token=[0-9a-f]{32}", after)
    assert len({(kind, got[k]) for k, (kind, _) in enumerate(flat)}) == len(set(flat))


def test_a_part_of_a_name_is_tied_to_the_whole(spark):
    texts = ["Mr John Smith met Mrs Smith, Mr Smith-Jones and Frau Dora Jones.", "Mr. Smith", "Mr James Smith", "Dr John Braun"]
    got = {r["doc_id"]: r["text"] for r in surrogates.replace(docs_of(spark, texts)).collect()}
    m = re.fullmatch(r"Mr (\w+) (\w+) met Mrs (\w+), Mr (\w+)-(\w+) and Frau (\w+) (\w+)\.", got[0])
    assert m and m[2] == m[3] == m[4] and m[5] == m[7] and m[2] != m[5] and m[1] != m[6]
    assert got[1] == f"Mr. {m[2]}" and re.fullmatch(rf"Mr \w+ {m[2]}", got[2]) and m[1] not in got[2] and got[3].startswith(f"Dr {m[1]} ")
    other = {r["doc_id"]: r["text"] for r in surrogates.replace(docs_of(spark, texts), key="another").collect()}
    assert other[1] != got[1]


def test_the_key_is_the_sessions(spark):
    import hashlib
    import hmac

    one = spark.range(1).select(surrogates.keyed_digest(F.lit("a message"), "a key").alias("h"), surrogates.keyed_digest(F.lit("x"), "k" * 99).alias("l")).first()
    assert one["h"] == hmac.new(b"a key", b"a message", hashlib.sha256).hexdigest() and one["l"] == hmac.new(b"k" * 99, b"x", hashlib.sha256).hexdigest()
    docs = docs_of(spark, ["mail joe@example.com"])
    before = surrogates.replace(docs).first()["text"]
    spark.conf.set(surrogates.KEY_SETTING, "a secret")
    try:
        assert surrogates.replace(docs).first()["text"] == surrogates.replace(docs, key="a secret").first()["text"] != before
    finally:
        spark.conf.unset(surrogates.KEY_SETTING)


def test_columns_of_any_name_stay(spark):
    docs = docs_of(spark, ["mail joe@example.com", "none"]).select("*", *[F.lit(k).alias(c) for k, c in enumerate(("n_entities", "__found", "__digest", "__shown", "__new", "digest", "kind"))])
    rows = sorted(surrogates.replace(docs).collect())
    assert [r["n_entities"] for r in rows] == [0, 0] and [r["n_entities_"] for r in rows] == [1, 0] and rows[0]["kind"] == 6
    assert surrogates.replace(docs, counted=None).columns == docs.columns


def test_a_megabyte_of_near_entities_ends(spark):
    many = " ".join(f"u{i}@example{i % 50}.com" for i in range(20_000))
    texts = [
        "x@" + "a." * 500_000 + "1", "a.a@" * 250_000, many, "password=" + "_" * 1_000_000, "+1 " * 300_000, "1234 " * 200_000, "DE12 " * 200_000, "Mr " * 300_000,
        "x@" + "a-" * 500_000, "1.2.3." * 160_000, "-" * 1_000_000 + "@", "Mr A" + "b" * 1_000_000, "x@" + "y" * 1_000_000 + ".com", "token: " + "A" * 1_000_000,
    ]
    began = time.time()
    rows = {r["doc_id"]: (r["n_entities"], r["size"]) for r in surrogates.replace(docs_of(spark, texts)).select("doc_id", "n_entities", F.length("text").alias("size")).collect()}
    assert rows[2][0] == 20_000 and rows[0][0] == 0 and rows[13] == (1, 1_000_007) and len(rows) == len(texts)
    assert time.time() - began < 150


# -- pages


def slow_text(page):
    import html

    dropped = re.sub(r"<!--.*?-->|<(script|style|noscript|template)\b.*?</\1\s*>", " ", page, flags=re.S | re.I)
    return html.unescape(re.sub(r"<[^>]*>", " ", dropped))


def test_visible_text_is_that_of_the_expressions():
    rng = random.Random(6)
    parts = ["<p>", "</p>", "word ", "<!-- a > b -->", "<script>if (a < b) {}</script >", "<STYLE x='1'>p{}</style>", "&amp;", " 1 > 0 ", "<br/>", "<template>in</template>", "<scripted>"]
    for _ in range(300):
        page = "".join(rng.choices(parts, k=rng.randint(0, 20)))
        assert langid.visible_text(page) == slow_text(page), page


@pytest.mark.parametrize("part", ["<meta ", "<script>", "<!--", "<html ", "<", "<html lang=" + " " * 1000, "lang =  ", "<style></style", "<p>a</p>", "<meta name=language content=" + " " * 100 + ">", "&#"])
def test_a_megabyte_of_markup_is_read_in_seconds(part):
    page = part * (1_000_000 // len(part))
    began = time.time()
    langid.declared_language(page), langid.visible_text(page), langid.gram_numbers(page)
    assert time.time() - began < 8


def test_languages_are_named_whole():
    assert langid.declared_language("<HTML dir=ltr LANG = 'est'><body lang=fr>") == "est"
    assert langid.declared_language("<html><meta content='pt_BR' property=og:locale><body>") == "pt"
    assert langid.declared_language("<html data-lang=fr><meta name='languages' content='de'>") is None
    assert langid.address_parts("https://de.news.example.co.uk/fr-CA/x?hl=es") == ("de.news.example.co.uk", "co.uk", ["de", "fr", "es"], "uk")


def test_priors_and_confusion_are_those_of_counts(spark):
    rng = random.Random(2)
    langs, hosts = ["de", "en", "est"], [("a.x.com", "x.com"), ("b.x.com", "x.com"), ("c.uk", "c.uk"), ("", "")]
    rows = []
    for _ in range(400):
        host, domain = rng.choice(hosts)
        rows.append((host, domain, rng.choice([*langs, None]), rng.choice([*langs, ".uk", ".de", None])))
    seen = spark.createDataFrame(rows, "host string, domain string, first string, address string")

    def shares(some, above):
        n = [sum(r[2] == x for r in some) for x in langs]
        return [(a + 8.0 * b) / (sum(n) + 8.0) for a, b in zip(n, above, strict=True)]

    import math

    top = shares(rows, [1 / 3] * 3)
    got = {r["host"]: r for r in langid.host_priors(seen, langs).collect()}
    for host, domain in hosts:
        want = shares([r for r in rows if r[0] == host], shares([r for r in rows if r[1] == domain], top))
        assert got[host]["prior"] == pytest.approx([math.log(x) for x in want]) and got[host]["rows"] == sum(r[0] == host for r in rows)
    table = {r["address"]: r["logs"] for r in langid.confusion(seen, "address", langs).collect()}
    assert set(table) == {*langs, ".uk", ".de"}
    for k, x in enumerate(langs):
        counts = {d: sum(r[2] == x and r[3] == d for r in rows) + (6 if d.lstrip(".") == x else 1) for d in table}
        assert {d: math.exp(v[k]) for d, v in table.items()} == pytest.approx({d: n / sum(counts.values()) for d, n in counts.items()})


# -- decontamination


def test_overlaps_are_those_of_all_alignments(spark):
    """Every alignment of every item with every document, whatever the hashes."""
    rng = random.Random(21)
    words = [f"w{i}" for i in range(60)]
    line = rng.choices(words, k=14)
    items = [rng.choices(words, k=rng.choice([5, 13, 15, 20, 40])) for _ in range(25)] + [line + rng.choices(words, k=9) for _ in range(8)]
    texts = []
    for _ in range(60):
        text = rng.choices(words, k=rng.choice([0, 3, 30, 90]))
        for _ in range(2):
            item = list(rng.choice(items))
            for at in rng.sample(range(len(item)), rng.randint(0, len(item) // 4)):
                item[at] = rng.choice(words)
            cut = rng.randint(0, len(text))
            text[cut:cut] = item[rng.randint(0, 3) :]
        texts.append(text)
    texts.append(line * 20)
    want = {}
    for d, text in enumerate(texts):
        for k, item in enumerate(items):
            for offset in range(1 - len(item), len(text)):
                lo, hi = max(0, -offset), min(len(item), len(text) - offset)
                total = [0]
                for i in range(lo, hi):
                    total.append(total[-1] + (1 if text[i + offset] == item[i] else -4))
                longest = max((j - i for i in range(len(total)) for j in range(i + 1, len(total)) if total[j] >= total[i]), default=0)
                if longest >= min(13, len(item)):
                    want[d, k] = max(longest, want.get((d, k), 0))
    bench = spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(items)], "item_id long, text string")
    rows = spaced.contaminated(docs_of(spark, [" ".join(t) for t in texts]), bench).collect()
    assert {(r["doc_id"], r["item_id"]): r["n_words"] for r in rows} == want and len(rows) == len(want) > 60
