"""Pseudonyms against a plain Feistel network, and texts of numbers that must stay."""

import hashlib
import random

from pyspark.sql import functions as F

from duelframe.llm import pseudonyms


def drawn(key, tag, k, other, bits):
    return hashlib.new(f"sha{bits}", "|".join([key, tag, str(k), str(other)]).encode()).hexdigest()


def plain_number(l, r, a, b, tag, key):
    for k in range(1, pseudonyms.ROUNDS + 1):
        if k % 2:
            l = (l + int(drawn(key, tag, k, r, 256)[:12], 16)) % a
        else:
            r = (r + int(drawn(key, tag, k, l, 256)[:12], 16)) % b
    return l, r


def plain_string(s, tag, key):
    def step(half, other, k):
        stream, out = drawn(key, tag, k, other, 512), ""
        for i, c in enumerate(half):
            by = int(stream[2 * i % 126:][:2], 16)
            for base, size in (("0", 10), ("a", 26), ("A", 26)):
                if base <= c < chr(ord(base) + size):
                    c = chr(ord(base) + (ord(c) - ord(base) + by) % size)
                    break
            out += c
        return out

    l, r = s[:len(s) // 2], s[len(s) // 2:]
    for k in range(1, pseudonyms.ROUNDS + 1):
        if k % 2:
            l = step(l, r, k)
        else:
            r = step(r, l, k)
    return l + r


def test_numbers_and_strings_equal_a_plain_network(spark):
    for key in ("pseudonym-key-1", "another key"):
        d = spark.range(300)
        new = pseudonyms.permuted_number(F.floor(F.col("id") / 773), F.col("id") % 773, 189, 773, "date", lambda x: x["l"] * 773 + x["r"], key)
        text = F.concat(F.format_string("%05d-Ab", "id"), F.col("id").cast("string"), F.lit("zZ_9"))
        for r in d.select("id", new.alias("n"), text.alias("t"), pseudonyms.permuted_string(text, "phone", key).alias("s")).collect():
            l, rest = plain_number(r.id // 773, r.id % 773, 189, 773, "date", key)
            assert r.n == l * 773 + rest
            assert r.s == plain_string(r.t, "phone", key)


def test_tables_of_numbers_stay(spark):
    rng = random.Random(1)
    texts = [" ".join(str(rng.randint(10, 999)) for _ in range(40)) for _ in range(150)]
    texts += [" ".join(str(rng.randint(1000, 99999)) if k % 3 else "7" for k in range(40)) for _ in range(50)]
    texts += ["0000 0000 0000 0000", "9111 1111 1111 1111", "1" * 40]
    got = [r.text for r in pseudonyms.pseudonymise(spark.createDataFrame([(t,) for t in texts], "text string").coalesce(1)).collect()]
    changed = sum(a != b for a, b in zip(texts, got))
    assert changed == 0


def test_cards_are_found_in_every_form_and_key_matters(spark):
    texts = ["4111 1111 1111 1111", "4111-1111-1111-1111", "4111111111111111", "3782 822463 10005", "order 12 4111 1111 1111 1111 end",
             "4111111111111111 " + "word " * 20_000, None, "", "4111111111111111", "4111111111111111"]
    d = spark.createDataFrame([(t,) for t in texts], "text string").coalesce(1)
    one, two = ([r.text for r in pseudonyms.pseudonymise(d, key=k).collect()] for k in ("a", "b"))
    for t, a, b in zip(texts, one, two):
        assert (a, b) == (t, t) if not t else len({t, a, b}) == 3 and len(a) == len(t)
    assert one[2] == one[8] == one[9] and one[5].startswith(one[2] + " word")  # equal values stay equal


def test_an_empty_table(spark):
    assert pseudonyms.pseudonymise(spark.createDataFrame([], "text string, finds string"), finds="found").count() == 0


def test_runs_of_any_length(spark):
    """A run of digits or of characters of two widths takes no stack frame a turn, and a value costs a look a place."""
    n = 20_000
    value = "aB3\U0001F600" * (n // 4) + "z"
    texts = ["1" * n, "12 " * n, "1-" * n + "1", "4111 1111 1111 1111 " * 50, f'password="{value}" end', "token=" + "0f" * (n // 2)]
    got = [r.text for r in pseudonyms.pseudonymise(spark.createDataFrame([(t,) for t in texts], "text string").coalesce(1)).collect()]
    assert got[:3] == texts[:3]
    assert got[3] != texts[3] and set(got[3].split(" ")[3::4]) == {got[3][15:19]} and len(got[3]) == len(texts[3])
    assert got[4] == f'password="{plain_string(value, "secret", pseudonyms.KEY)}" end'
    assert got[5] != texts[5] and set(got[5][6:]) <= set("0123456789abcdef") and len(got[5]) == len(texts[5])


def test_digits_go_back_to_their_places(spark):
    rows = [("+49 (171) 456-78", "1234567890"), ("12", "98"), ("a1", "7"), ("1", "5")]
    d = spark.createDataFrame(rows, "w string, d string")
    got = [r[0] for r in d.select(pseudonyms.refilled(F.col("w"), F.col("d"))).collect()]
    assert got == ["+12 (345) 678-90", "98", "a7", "5"]
