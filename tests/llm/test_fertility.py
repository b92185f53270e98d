import re
from collections import Counter

import duckdb
import numpy as np

from groundling.llm import fertility, queries
from groundling.llm.fertility import BANDS, quality_rules

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def base(text):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    n = Counter(windows)
    hit = {i + j for i, w in enumerate(windows) if n[w] > 1 for j in range(8)}
    lines, seen, dup = text.split("\n"), set(), 0
    for x in lines:
        if WORD.search(x):
            dup += x in seen
            seen.add(x)
    failed = len(words) < 20 or 100 * len(hit) > 30 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(hit), failed


def verdict(text, lang):
    """The method in scalar steps, for languages with a band."""
    encoder, _, pieces, single = fertility._vocabularies(fertility.vocabulary_paths())
    ids, broken = encoder.encode_ordinary(text), pieces.encode(text)
    n = len(ids)
    p = np.array(list(Counter(ids).values())) / n
    cpt, cpp, fell, h = len(text) / n, len(text) / len(broken), sum(bool(single[i]) for i in broken) / len(broken), -(p * np.log2(p)).sum()
    least, least_pieces = BANDS[lang]
    wide = 3 / n**0.5 + 10 / n
    return least - wide <= cpt <= 12 and least_pieces - wide <= cpp <= 12 and fell <= 0.08 + 0.6 / n**0.5 and h >= min(4.6, 0.72 * np.log2(n) - 0.5)


def test_query_equals_brute_force(spark):
    d = "/root/testdata/sf0.01"
    docs = {r[0]: r[1:] for r in duckdb.sql(f"select doc_id, text, lang from '{d}/documents.parquet'").fetchall()}
    rows = queries.op2_fertility(spark, d).collect()
    assert len(rows) == len(docs)
    for r in rows:
        text, lang = docs[r.doc_id]
        got = (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed)
        assert got == base(text)
        assert r.kept == (not r.base_failed and verdict(text, lang))


def test_labelled_clean_rows_stay(spark):
    d = "/root/testdata/sf0.1"
    good = duckdb.sql(f"select doc_id from '{d}/labels.parquet' where quality = 1").fetchall()
    kept = {r.doc_id: (r.kept, r.base_failed) for r in queries.op2_fertility(spark, d).collect()}
    lost = [x for (x,) in good if not kept[x][0] and not kept[x][1]]
    assert len(lost) <= 0.002 * len(good)


ENGLISH = """The committee met on Tuesday evening to discuss the proposed changes to the harbour, which had been delayed twice because of bad weather. Members agreed
that the new breakwater should be finished before winter, although several of them were worried about its cost. After a long debate the chair asked the engineers to return in
a month with cheaper plans, and thanked the residents who had come to listen."""
OTHERS = {
    "de": "Der Ausschuss traf sich am Dienstagabend, um die geplanten Änderungen am Hafen zu besprechen, die wegen des schlechten Wetters schon zweimal verschoben worden waren. Nach langer Debatte bat der Vorsitzende die Ingenieure, in einem Monat mit günstigeren Plänen zurückzukehren.",
    "fr": "Le comité s'est réuni mardi soir pour discuter des changements prévus dans le port, déjà retardés deux fois à cause du mauvais temps. Après un long débat, le président a demandé aux ingénieurs de revenir dans un mois avec des plans moins coûteux, et il a remercié les habitants.",
    "it": "Il comitato si è riunito martedì sera per discutere le modifiche previste al porto, già rinviate due volte a causa del maltempo. Dopo un lungo dibattito il presidente ha chiesto agli ingegneri di tornare fra un mese con progetti meno costosi.",
    "ru": "Комитет собрался во вторник вечером, чтобы обсудить предложенные изменения в гавани, которые уже дважды откладывались из-за плохой погоды. После долгих споров председатель попросил инженеров вернуться через месяц с более дешёвыми планами и поблагодарил жителей города.",
    "el": "Η επιτροπή συνεδρίασε το βράδυ της Τρίτης για να συζητήσει τις προτεινόμενες αλλαγές στο λιμάνι, οι οποίες είχαν καθυστερήσει δύο φορές εξαιτίας του κακού καιρού. Μετά από μεγάλη συζήτηση ο πρόεδρος ζήτησε από τους μηχανικούς να επιστρέψουν.",
    "ko": "위원회는 화요일 저녁에 모여 나쁜 날씨 때문에 이미 두 번이나 미뤄진 항구 공사 계획을 논의했다 오랜 토론 끝에 위원장은 기술자들에게 한 달 뒤에 더 저렴한 계획을 가지고 돌아와 달라고 요청했고 참석한 주민들에게 감사를 전했다",
}


def test_ordinary_prose_stays_and_noise_goes(spark):
    rng = np.random.default_rng(4)
    noise = [" ".join("".join(rng.choice(list("bcdfghjklmnpqrstvwxz0123456789"), 9)) for _ in range(60)), " ".join("ab" for _ in range(80)), "Ã©â‚¬â„¢ÂºÃŸ" * 60 + " x" * 30]
    rows = [(0, ENGLISH, "en")] + [(i + 1, t, k) for i, (k, t) in enumerate(OTHERS.items())] + [(20, ENGLISH, None), (21, ENGLISH, "it")] + [(100 + i, t, x) for i, t in enumerate(noise) for x in ("en",)]
    got = {r.doc_id: r.quality for r in quality_rules(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert [i for i, q in got.items() if i < 100 and not q.kept] == [] and [i for i, q in got.items() if i >= 100 and q.kept] == []
    assert [got[i + 1].script for i in range(len(OTHERS))] == ["latin", "latin", "latin", "cyrillic", "greek", "hangul"]


def test_edges(spark):
    long_word, wide = "x" * 300_000, "one two three four five six seven eight nine\n" * 4000
    texts = [None, "", " \t\n", long_word, wide, "日本語 " * 40, "a\x0bb a\n\nb a\n b a\n\x85\x85"]
    df = spark.createDataFrame([(i, t, None, "clash") for i, t in enumerate(texts)], "doc_id long, text string, lang string, kept string")
    rows = sorted(quality_rules(df).collect())
    assert [tuple(r.quality)[:6] for r in rows] == [base(t) for t in texts]
    assert not rows[0].quality.kept and rows[0].kept == "clash"
    assert quality_rules(df.limit(0)).count() == 0
    clash = quality_rules(df.where("doc_id = 1"), out_col="kept").first()
    assert clash.kept_1 == "clash" and clash.kept.n_words == 0
