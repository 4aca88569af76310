"""Personal data in texts written by hand, none from the module's own generator.

Bases are always found, so these are other forms. Precision and recall by kind are in the README.
"""

from __future__ import annotations

from collections import Counter

from pointlake.llm import pii

#: (kind, text, the span in it).
THERE = [
    ("email", "You can reach me under anna.schmidt (at) posteo (dot) de any time.", "anna.schmidt (at) posteo (dot) de"),
    ("email", "Bitte an k.meier [at] uni-koeln [punkt] de senden", "k.meier [at] uni-koeln [punkt] de"),
    ("email", "contact: support at example dot com", "support at example dot com"),
    ("email", "Mail me: josé.núñez@correo.es", "josé.núñez@correo.es"),
    ("email", "write to info @ museum.org for tickets", "info @ museum.org"),
    ("email", "her address is lena{at}web{dot}de", "lena{at}web{dot}de"),
    ("email", "drop a note to bob[at]acme[dot]co[dot]uk please", "bob[at]acme[dot]co[dot]uk"),
    ("email", "Kontakt: x.y (at) firma punkt de", "x.y (at) firma punkt de"),
    ("email", "escríbeme a maria.lopez arroba gmail punto com", "maria.lopez arroba gmail punto com"),
    ("email", "send it to tim <at> lab <dot> net", "tim <at> lab <dot> net"),
    ("ip", "the server 192[.]168[.]0[.]12 did not answer", "192[.]168[.]0[.]12"),
    ("ip", "blocked 10(.)20(.)30(.)40 this morning", "10(.)20(.)30(.)40"),
    ("ip", "traffic from 8[dot]8[dot]4[dot]4 was seen", "8[dot]8[dot]4[dot]4"),
    ("ip", "host 172 . 16 . 254 . 1 is down", "172 . 16 . 254 . 1"),
    ("ip", "ping 203[.]0[.]113[.]77 twice", "203[.]0[.]113[.]77"),
    ("ip", "logins came from 198(dot)51(dot)100(dot)3 only", "198(dot)51(dot)100(dot)3"),
    ("card", "my Visa is 4111.1111.1111.1111, valid till June", "4111.1111.1111.1111"),
    ("card", "Amex 3782 822463 10005 was charged", "3782 822463 10005"),
    ("card", "paid by card 5555/5555/5555/4444", "5555/5555/5555/4444"),
    ("card", "Karte 378282246310005 belastet", "378282246310005"),
    ("card", "credit card: 4012 - 8888 - 8888 - 1881", "4012 - 8888 - 8888 - 1881"),
    ("card", "card number 6011.0009.9013.9424 on file", "6011.0009.9013.9424"),
    ("card", "Diners 3056 930902 5904", "3056 930902 5904"),
    ("phone", "Call (212) 555-0187 after six", "(212) 555-0187"),
    ("phone", "Tel. 030/12345678", "030/12345678"),
    ("phone", "mobil 0171/1234567 oder 0171 7654321", "0171/1234567"),
    ("phone", "phone 415-555-2671", "415-555-2671"),
    ("phone", "appelez le 01 42 68 53 00 svp", "01 42 68 53 00"),
    ("phone", "her mobile is 07700 900123", "07700 900123"),
    ("phone", "fax: 0049 89 1234567", "0049 89 1234567"),
    ("phone", "ring 020 7946 0018 for the desk", "020 7946 0018"),
    ("phone", "tel: 555.123.4567", "555.123.4567"),
    ("phone", "WhatsApp 6505551234 works too", "6505551234"),
    ("phone", "telefono 91 123 45 67", "91 123 45 67"),
]
NOT_THERE = [
    "In 2023 2024 2025 2026 the fair took place in Leipzig.", "The hut stands at 52.5200 13.4050 on the map.", "He counted 10 20 30 40 50 60 and stopped.", "tracking 940010000000 0000 0000 left the depot",
    "order 4500123456 was shipped on 2021-03-04", "ISBN 978-0-306-40615-7 is out of print", "pi is 3.141592653589793", "version 10.15.7.2301 was released", "see section 4 . 12 . 7 . 1 of the manual", "commit 3f786850e387550fdab836ed7e6dc881de23001b",
    "uuid 123e4567-e89b-12d3-a456-426614174000", "Meet us at the gate . Then walk on.", "look @ home. Nothing there", "they met on 12/05/2019 and 13/06/2020", "the ratio is 1234/5678/9012", "He was born 4.12.1950 and died 5.1.2011",
    "population 1 234 567 in 2010", "invoice 2020/11/00012345", "items 0001 0002 0003 0004 0005", "score 21 14 21 17 15 13", "build 20231124.1842", "the sum of 1000000 and 2500000", "room 12 at dot matrix street", "prices 12.99 24.99 36.50 48.00",
    "we were at work dot by dot we drew it", "sha 0000000000000000000000000000000000000000", "barcode 4006381333931", "port 8080 8081 8082 8083", "temperature 20.5 21.0 21.5 22.0", "lines 100-200 300-400 500-600",
]


def test_base_forms_stay_apart(spark):
    """None of the spans is one that the base patterns give, so the trees are what is measured."""
    found = pii.pii_spans(spark.createDataFrame([(t,) for _, t, _ in THERE] + [(t,) for t in NOT_THERE], "text string")).collect()
    for r in found:
        spans = [span for _, t, span in THERE if t == r["text"]]
        for p in r["pii"]:
            assert not p["base"] or not any(r["text"][p["s"] : p["e"]] == span for span in spans), r


def measured(spark):
    rows = [(k, t) for k, (_, t, _) in enumerate(THERE)] + [(1000 + k, t) for k, t in enumerate(NOT_THERE)]
    got = {r["id"]: [p for p in r["pii"] if not p["base"]] for r in pii.pii_spans(spark.createDataFrame(rows, "id long, text string")).collect()}
    hit, wrong, all_ = Counter(), Counter(), Counter(k for k, _, _ in THERE)
    for k, (kind, text, span) in enumerate(THERE):
        at = text.index(span)
        for p in got[k]:
            name = pii.KINDS[p["kind"]]
            over = min(p["e"], at + len(span)) - max(p["s"], at)
            # Another number in the text (a second phone) is not counted either way.
            if name == kind and 10 * over >= 8 * len(span):
                hit[kind] += 1
            elif over > 0:
                wrong[name] += 1
    for k in range(len(NOT_THERE)):
        wrong.update(pii.KINDS[p["kind"]] for p in got[1000 + k])
    return hit, wrong, all_, got


def test_precision_and_recall(spark):
    hit, wrong, all_, got = measured(spark)
    print({k: (hit[k], all_[k], wrong[k]) for k in pii.KINDS}, [NOT_THERE[k - 1000] for k, v in got.items() if k >= 1000 and v], [THERE[k] for k, v in got.items() if k < 1000 and not v])
    flagged, true = sum(hit.values()) + sum(wrong.values()), sum(hit.values())
    assert true >= 0.8 * sum(all_.values()) and true >= 0.85 * flagged
