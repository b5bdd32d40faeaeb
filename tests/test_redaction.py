"""Redaction against a plain scan, and the check digits."""

import random
import re

import pytest

from tarnwright.operators import redaction as rd


def test_check_digits():
    assert rd.luhn("4111111111111111") and rd.luhn("79927398713") and not rd.luhn("4111111111111112") and not rd.luhn("79927398710")
    assert rd.mod97("DE89370400440532013000") and rd.mod97("GB82WEST12345698765432") and not rd.mod97("DE88370400440532013000")


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("pay 4111 1111 1111 1111 now", "pay [CARD] now"),
        ("pay 4111111111111112 now", "pay 4111111111111112 now"),
        ("0000000000000000", "0000000000000000"),
        ("to DE89 3704 0044 0532 0130 00 AND MORE", "to [IBAN] AND MORE"),
        ("GB82WEST12345698765432, GB83WEST12345698765432", "[IBAN], GB83WEST12345698765432"),
        ("a.b+c@mail.example.org.", "[EMAIL]."),
        ("1.2.3.4 1.2.3.256 1.2.3 1.2.3.4.5 255.255.255.255", "[IP] 1.2.3.256 1.2.3 1.2.3.4.5 [IP]"),
        ("+1 (743) 555-3824 and (743) 555-3824", "[PHONE] and [PHONE]"),
        ("é 24be64439e3e49cf46b2d7c90f3602a3d0b907ff é", "é [SECRET] é"),
        ("f" * 40 + " " + "1" * 40, "f" * 40 + " " + "1" * 40),
        ("1.2.3.4@5.example.com", "[EMAIL]"),  # the longest of what overlaps
        ("😀 1.2.3.4 😀", "😀 [IP] 😀"),
        ("", ""),
        (None, None),
    ],
)
def test_detectors(spark, text, want):
    out = rd.redact(spark.createDataFrame([(1, text)], "k int, text string")).first()
    assert out.redacted == want and (out.spans == []) == (want == text)


def plain(text, strings):
    """All finds by a scan of every place, and then the longest that is left, one after another."""
    found = [(m.start(), m.start() + n, d.kind) for d in rd.DETECTORS for m in re.finditer(d.pattern, text) if (n := d.length(m[0]))]
    found += [(i, i + len(s), rd.FIXED) for s in strings if s for i in range(len(text)) if text.startswith(s, i)]
    kinds = [*(d.kind for d in rd.DETECTORS), rd.FIXED]
    taken = []
    while found:
        best = min(found, key=lambda f: (f[0] - f[1], f[0], kinds.index(f[2])))
        taken.append(best)
        found = [f for f in found if f[1] <= best[0] or f[0] >= best[1]]
    taken.sort()
    out, at = "", 0
    for a, b, k in taken:
        out, at = out + text[at:a] + f"[{k}]", b
    return taken, out + text[at:]


@pytest.mark.parametrize("most", [1_000_000, 10])  # one automaton, or several one after another
def test_documents_against_a_plain_scan(spark, most):
    rng = random.Random(6)
    strings = ["ab", "abab", "ba", "a b", "1.2", "é😀", "abcabcabcabc", None, "", "ab"]
    bits = ["ab", "a", "b ", "1.2.3.4", "4111 1111 1111 1111", "x@y.zz", "é😀", " ", "c", "0", "DE89 3704 0044 0532 0130 00"]
    texts = ["".join(rng.choices(bits, k=rng.choice([1, 5, 40]))) for _ in range(120)] + [None, "", "ab" * 300]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, kind string").repartition(3)
    fixed = spark.createDataFrame([(s,) for s in strings], "words string")
    out = {r.doc_id: r for r in rd.redact(docs, fixed, most=most).collect()}
    for i, t in enumerate(texts):
        spans, redacted = plain(t, strings) if t is not None else ([], None)
        assert ([tuple(s) for s in out[i].spans], out[i].redacted, out[i].kind) == (spans, redacted, "x")
    none = rd.redact(docs, fixed.filter("words = 'nothing'"), spans="s", redacted="r")
    assert none.columns == ["doc_id", "text", "kind", "s", "r"] and none.filter("size(s) > 0").count() > 0
    assert rd.redact(docs.filter("false"), fixed).count() == 0
    with pytest.raises(ValueError):
        rd.redact(docs, redacted="kind")


def test_counts_and_their_sql_where_finds_overlap(spark, tmp_path):
    """A card number within a secret, beside an address or within an account number counts only if it is the longest."""
    from oracle import duck_rows, spark_rows

    from tarnwright.plans import catalog

    rng = random.Random(9)
    bits = ["068c002651439458202064d35406d6b34bf01abe", "38.211.12.42", " ", " 4366089147969128", "4495589438270767 ", "+1 (858) 555-2128", "hnof.70@mail0.example.com", "DE89 3704 0044 0532 0130 00", " AND", "GB82WEST12345698765432", "é", ", "]
    texts = ["".join(rng.choices(bits, k=rng.choice([1, 2, 3, 8]))) for _ in range(150)] + [bits[0], bits[1] + bits[3], bits[4] + "42.73.240.87", None, ""]
    spark.createDataFrame([(i // 2, t) for i, t in enumerate(texts)], "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "embeddings", "pages", "benchmark", "labels", "conversations"):
        (tmp_path / f"{t}.parquet").symlink_to(f"/root/testdata/sf0.001/{t}.parquet")
    got = spark_rows(catalog.QUERIES["redact_counts"](spark, str(tmp_path)))
    assert got == duck_rows(catalog.ORACLE_SQL["redact_counts"], str(tmp_path))
