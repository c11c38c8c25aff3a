from __future__ import annotations

import math
from collections import Counter

import duckdb
import tiktoken
from llm_fixtures import DATA, docs_of, rows_of, sample_texts  # noqa: F401

from spectraloom.llm import quality, tokens


def brute(text):
    text = text or ""
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", text) if w]
    lines = [x for x in text.split("\n") if any(c not in " \t\v\f\r" for c in x)]
    dup = sum(x in lines[:i] for i, x in enumerate(lines))
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often = Counter(grams)
    covered = {i + j for i, g in enumerate(grams) if often[g] > 1 for j in range(3)}
    symbols = sum(c in "#*$%&|<>" for w in words for c in w)
    return len(words), sum(map(len, words)), symbols, dup, len(covered)


EDGE = [
    (900, None), (901, ""), (902, " \n\n "), (903, "a b c"), (904, "a b c a b c"), (905, "x\ny\nx\n x\nx\r\nx\r\n"), (906, "w " * 20_000),
    (907, "#*$ %&|<> é 日本語 \x0b\x0c z"), (907, "#*$ %&|<> é 日本語 \x0b\x0c z"),
]


def test_base_measures_match_brute_force(spark, docs_of, sample_texts):
    rows = [*sample_texts[:80], *EDGE]
    got = rows_of(quality.measures(docs_of(rows, "true AS kept")))
    assert len(got) == len(rows)
    for r in got:
        want = brute(dict(rows)[r["doc_id"]])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want, r
        failed = want[0] < 50 or 100 * want[4] > 50 * want[0]
        assert r["base_failed"] == failed and not (failed and r["kept"])
    assert quality.measures(docs_of([])).count() == 0


def test_token_measures_match_plain_counts(sample_texts):
    path = quality.vocabulary_path()
    ranks = tokens.rank_vocabulary(path)
    import public_tokenizers

    own = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    by_id = {i: b for b, i in ranks.items()}
    for _, text in sample_texts[:40]:
        ids = own.encode_ordinary(text)
        n, chars, fallback, entropy = quality.fertility(text, tokens.rank_encoder(path), tokens.fallback_ids(path))
        broken = sum(1 for i in ids if by_id[i].decode(errors="ignore").encode() != by_id[i])
        h = -sum(c / len(ids) * math.log2(c / len(ids)) for c in Counter(ids).values())
        assert n == len(ids) and chars == len(text) / n and abs(fallback - broken / n) < 1e-12
        assert abs(entropy - h / math.log2(max(2, n))) < 1e-9


def test_bands_keep_prose_and_reject_symbol_runs(spark):
    prose, junk = [], []
    labels = dict(duckdb.sql(f"SELECT doc_id, quality FROM '{DATA}/labels.parquet'").fetchall())
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    for r in rows_of(quality.measures(docs)):
        if not r["base_failed"] and r["doc_id"] in labels:
            (prose if labels[r["doc_id"]] else junk).append(r["kept"])
    assert all(prose) and len(prose) > 20 and (not junk or sum(junk) < len(junk))


def test_scripts():
    assert quality.script("Привет мир") == "cyrillic or greek" and quality.script("日本語のテキスト") == "cjk"
    assert quality.script("hello, 123") == "latin" == quality.script("") == quality.script("12") and quality.script("שלום") == "other"


def test_stage_returns_the_documents_columns(spark, docs_of, sample_texts):
    good = next(r["doc_id"] for r in rows_of(quality.measures(docs_of(sample_texts))) if r["kept"])
    good = dict(sample_texts)[good]
    df = docs_of([(1, good), (2, "too short"), (3, None), (None, good), (1, good)], "false AS kept")
    kept = quality.keep_good(df)
    assert kept.columns == df.columns and sorted(str(r["doc_id"]) for r in rows_of(kept)) == ["1", "1", "None"]
    assert all(r["kept"] is False and r["text"] == good for r in rows_of(kept))


REAL = {
    "en": "All human beings are born free and equal in dignity and rights. They are endowed with reason and conscience and should "
    "act towards one another in a spirit of brotherhood. Everyone is entitled to all the rights and freedoms set forth in this "
    "Declaration, without distinction of any kind, such as race, colour, sex, language, religion, political or other opinion, "
    "national or social origin, property, birth or other status.",
    "de": "Alle Menschen sind frei und gleich an Würde und Rechten geboren. Sie sind mit Vernunft und Gewissen begabt und sollen "
    "einander im Geist der Brüderlichkeit begegnen. Jeder hat das Recht auf Leben, Freiheit und Sicherheit der Person. Niemand "
    "darf der Folter oder grausamer, unmenschlicher oder erniedrigender Behandlung oder Strafe unterworfen werden. Jeder hat das "
    "Recht, überall als rechtsfähig anerkannt zu werden.",
    "fr": "Tous les êtres humains naissent libres et égaux en dignité et en droits. Ils sont doués de raison et de conscience et "
    "doivent agir les uns envers les autres dans un esprit de fraternité. Tout individu a droit à la vie, à la liberté et à la "
    "sûreté de sa personne. Nul ne sera tenu en esclavage ni en servitude.",
    "es": "Todos los seres humanos nacen libres e iguales en dignidad y derechos y, dotados como están de razón y conciencia, deben "
    "comportarse fraternalmente los unos con los otros. Todo individuo tiene derecho a la vida, a la libertad y a la seguridad de "
    "su persona. Nadie estará sometido a esclavitud ni a servidumbre.",
}


def test_real_prose_is_kept(spark):
    rows = [(i, text, lang) for i, (lang, text) in enumerate([*REAL.items(), (None, REAL["en"])])]
    got = rows_of(quality.measures(spark.createDataFrame(rows, "doc_id bigint, text string, lang string")))
    assert len(got) == 5 and all(r["kept"] and r["chars_per_token"] > 3.3 for r in got), got


def test_long_clean_prose_is_kept_and_long_junk_not(spark):
    docs = duckdb.sql(
        "SELECT lang, quality, text FROM '/root/testdata/sf0.1/documents.parquet' JOIN '/root/testdata/sf0.1/labels.parquet' "
        "USING (doc_id) WHERE lang IN ('en', 'de', 'fr', 'es') ORDER BY doc_id"
    ).fetchall()
    rows = []
    for lang in ("en", "de", "fr", "es"):
        prose = list(dict.fromkeys(t for g, q, t in docs if g == lang and q == 1))
        rows.append((len(rows), "\n".join(prose)[:400_000], lang))
    rows.append((4, max((t for g, q, t in docs if q == 0), key=len), "en"))
    got = {r["doc_id"]: r for r in rows_of(quality.measures(spark.createDataFrame(rows, "doc_id bigint, text string, lang string")))}
    assert all(got[i]["kept"] and got[i]["n_tokens"] > 100_000 for i in range(4)), got
    assert not got[4]["base_failed"] and not got[4]["kept"] and got[4]["token_entropy"] < 0.45


def test_long_runs(spark, docs_of):
    """Runs of a million blanks, lines and letters; what is cut at blanks gives the library's own ids."""
    from spectraloom.llm import tokens

    path = quality.vocabulary_path()
    encode = tokens.rank_encoder(path)
    import public_tokenizers
    import tiktoken

    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=tokens.rank_vocabulary(path), special_tokens={})
    for white in (" ", "\n", " \t\n", "\xa0 ", "\u3000"):
        for text in (f"a{white * 6_000}b", f"{white * 9_000}", f"{white * 5_000} word{white * 5_001}", f"x {white * 5_003}\n.\n"):
            assert encode(text).tolist() == own.encode_ordinary(text)
    rows = ["word " + " " * 1_000_000 + "end", "\n" * 1_200_000, " \n" * 600_000 + "x", "a" * 1_000_000, "!" * 500_000, "1" * 500_000]
    got = {r["doc_id"]: r for r in rows_of(quality.measures(docs_of(rows)))}
    assert [got[i]["n_words"] for i in range(6)] == [2, 0, 1, 1, 1, 1] and all(r["n_tokens"] > 0 for r in got.values())
