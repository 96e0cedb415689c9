"""Each operator against a brute-force version, on rows with nulls, empty and long texts, ties, repeats and clashing columns."""

import collections
import hashlib
import os
import pathlib
import random
import re
import subprocess
import sys
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyframe.llm import chat, decontaminate, html_extract, line_crf, mixing, near_dup, quality_rules, setsketch, suffix_dedup, suffix_stages, url_filter, warc
from tallyframe.llm.suffix_sort import suffix_order

DDL = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, size string, id string, fp string"
WORDS = ["alpha", "beta", "gamma", "delta", "eps", "zeta", "eta", "theta", "jota", "kappa", "mü", "ñu", "x"]


def sentence(draw, n):
    return " ".join(draw.choice(WORDS) + str(draw.randrange(40)) for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    draw = random.Random(3)
    base = [sentence(draw, n) for n in (3, 30, 80, 200, 60)]
    words = base[3].split()
    near = [" ".join(w if draw.random() > 0.01 else "new" for w in words) for _ in range(6)]
    far = [" ".join(words[:60] + sentence(draw, 120).split())]
    passage = sentence(draw, 60)
    found = [None, "", "   \n ", "one", "ONE", "two words", *base, base[2], base[2].upper(), *near, *far, f"{passage}\n{sentence(draw, 30)}", f"{sentence(draw, 20)} {passage}", "ab " * 4000, "same same same same " * 20, sentence(draw, 3000), "é" * 150, "# $ % " * 60]
    return found


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i, t, "en" if i % 3 else None, "abc"[i % 3] if i % 7 else None, len(t or ""), False, "s", "i", "f") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DDL).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DDL)


# 1 ---------------------------------------------------------------------------------------------


@pytest.mark.parametrize("depth", [10**9, 9])
def test_suffix_order(depth):
    draw = random.Random(depth)
    for _ in range(300):
        s = [draw.randrange(draw.choice([1, 2, 3])) for _ in range(draw.randint(0, 50))] * draw.choice([1, 3])
        order = suffix_order(np.array(s, np.int64), depth).tolist()
        heads = [s[i : i + depth] for i in order]
        assert sorted(order) == list(range(len(s))) and heads == sorted(heads)


@pytest.mark.parametrize("depth", [3, 4, 20])
def test_suffix_ranks_in_stages(spark, depth):
    draw = random.Random(depth)
    strings = [[draw.randrange(1, draw.choice([2, 3, 4])) for _ in range(draw.randint(1, 25))] for _ in range(14)]
    df = spark.createDataFrame([(c, i, s) for c, string in enumerate(strings) for i, s in enumerate(string)], "ctx long, i int, s long")
    got = {(r.ctx, r.i): r["rank"] for r in suffix_stages.suffix_ranks(df, depth).collect()}
    assert set(got) == {(c, i) for c, string in enumerate(strings) for i in range(len(string))}
    ordered = sorted(got, key=got.__getitem__)
    heads = [strings[c][i : i + depth] for c, i in ordered]
    assert heads == sorted(heads)
    equal = collections.defaultdict(set)
    for (c, i), rank in got.items():
        equal[rank].add(tuple(strings[c][i : i + depth]))
    assert all(len(v) == 1 for v in equal.values())


def test_repeats_sorted_in_stages(docs, texts):
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.repeat_report(docs, suffix_dedup.RepeatRules(stages=True)).collect()}
    assert got == brute_repeats(list(enumerate(texts)))


def brute_repeats(rows, length=100):
    seen, out = set(), {}
    for key, text in sorted(rows):
        data = (text or "").encode()
        gone = np.zeros(len(data), bool)
        for i in range(len(data) - length + 1):
            s = data[i : i + length]
            if s in seen:
                gone[i : i + length] = True
            seen.add(s)
        kept = bytes(b for b, g in zip(data, gone, strict=True) if not g)
        out[key] = (len(data), int(gone.sum()), int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum()), hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("rules", [suffix_dedup.RepeatRules(), suffix_dedup.RepeatRules(hot=3, batch=500, remembered=4), suffix_dedup.RepeatRules(length=16), suffix_dedup.RepeatRules(length=600), suffix_dedup.RepeatRules(length=2000)])
def test_repeats_equal_brute_force(docs, texts, rules):
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.repeat_report(docs, rules).collect()}
    assert got == brute_repeats(list(enumerate(texts)), rules.length)


def test_repeats_removed_keep_columns(docs, texts, none):
    out = suffix_dedup.remove_repeats(docs)
    assert out.columns == docs.columns
    rows = {r.doc_id: r for r in out.collect()}
    assert rows[0].text is None and rows[7].text == texts[7] and all(len(r.text or "") == r.n_chars for r in rows.values())
    assert suffix_dedup.remove_repeats(none).count() == 0 and suffix_dedup.repeat_report(none).count() == 0


def test_one_anchor_with_many_long_contexts_fits_the_sort(spark):
    """3,500 distinct texts of 700 bytes around one long passage: more than a suffix sort takes at once, so the anchor is split."""
    draw = random.Random(9)
    passage = "".join(draw.choice("abcdefgh") for _ in range(590))
    rows = [(i, f"{i:06d}" * 9 + passage + f"{i:06d}" * 9) for i in range(3500)] + [(9999, f"{7:06d}" * 9 + passage + f"{7:06d}" * 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    rules = suffix_dedup.RepeatRules(length=600)
    assert rules.split_beyond < 3500
    got = {r.doc_id: r.n_removed for r in suffix_dedup.repeat_report(df, rules).collect()}
    assert got[9999] == len(rows[-1][1]) and got == {k: v[1] for k, v in brute_repeats(rows, 600).items()}
    with pytest.raises(ValueError):
        suffix_dedup.RepeatRules(length=2001)


def test_repeats_in_parts(docs, texts, monkeypatch):
    """Texts cut into parts of 150 starts, pieces with their bits and rows taken seven at a time."""
    monkeypatch.setattr(suffix_dedup, "PART", 150)
    monkeypatch.setattr(suffix_dedup, "SLICE", 7)
    for rules in (suffix_dedup.RepeatRules(), suffix_dedup.RepeatRules(hot=3, batch=500, remembered=4)):
        got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.repeat_report(docs, rules).collect()}
        assert got == brute_repeats(list(enumerate(texts)))


#: Run in a process of its own, so that its workers have no other past.
MEMORY = """
import resource, sys
sys.path.insert(0, {root!r})
import pyarrow as pa
from pyspark.sql import functions as F
from tallyframe.llm.suffix_dedup import repeat_report
from tallyframe.session import build_session
spark = build_session("local[1]", "memory", **{{"spark.sql.shuffle.partitions": "1", "spark.driver.memory": "4g", "spark.ui.showConsoleProgress": "false"}})
line = "A line of forty-six characters, again and again.\n"
docs = spark.range(2).select(F.col("id").alias("doc_id"), F.when(F.col("id") == 0, F.repeat(F.lit("a"), 20_000_000)).otherwise(F.repeat(F.lit(line), 20_000_000 // len(line))).alias("text"))
found = {{r.doc_id: (r.n_bytes, r.n_removed, r.n_spans) for r in repeat_report(docs).collect()}}
n = 20_000_000 // len(line) * len(line)
assert found == {{0: (20_000_000, 20_000_000 - 1, 1), 1: (n, n - len(line), 1)}}, found

def peak(batches):
    for _ in batches:
        pass
    yield pa.RecordBatch.from_arrays([pa.array([resource.getrusage(resource.RUSAGE_SELF).ru_maxrss])], ["kb"])

print("PEAK", max(r.kb for r in spark.range(1).mapInArrow(peak, "kb long").collect()))
"""


def test_repetitive_texts_of_20_megabytes_within_a_gigabyte():
    """One letter, and one line: only what starts first stays. The largest worker held less than a gigabyte."""
    root = str(pathlib.Path(__file__).resolve().parents[2])
    done = subprocess.run([sys.executable, "-c", MEMORY.format(root=root)], capture_output=True, text=True, timeout=600, env={**os.environ, "PYTHONPATH": root})
    assert done.returncode == 0, done.stderr[-2000:]
    assert int(done.stdout.split("PEAK")[1]) < 1_000_000


def test_repeats_and_clashing_columns(docs, texts):
    extra = docs
    for name in ("hot", "fps", "marks", "_cut_spans", "_fps", "_anchor_id", "_mark_id", "_gone", "_mix_key", "_leak_spans", "mix_copies"):
        extra = extra.withColumn(name, F.lit("mine"))
    for out in (suffix_dedup.remove_repeats(extra), near_dup.keep_first_of_group(extra), mixing.mixed_documents(extra), quality_rules.keep_quality(extra), decontaminate.remove_leaks(extra, docs.sparkSession.createDataFrame([(1, texts[9])], "item_id long, text string"))):
        rows = out.collect()
        assert set(extra.columns) <= set(out.columns) and rows
        assert all(r[c] == "mine" for r in rows for c in ("hot", "fps", "marks", "_cut_spans", "_anchor_id", "_gone", "_mix_key", "_leak_spans", "mix_copies"))
    mixed = mixing.mixed_documents(extra)
    assert mixed.columns == [*extra.columns, "mix_copies_", "mix_finish"] and {r.mix_copies_ for r in mixed.collect()} <= {1, 2}


def test_repeats_with_null_and_equal_keys(spark):
    long = "".join(chr(97 + (i * i) % 26) for i in range(300))
    df = spark.createDataFrame([(None, long), (1, long), (1, long), (2, long)], "doc_id long, text string")
    got = sorted(((r.doc_id is None, r.doc_id), r.n_removed) for r in suffix_dedup.repeat_report(df).collect())
    assert [g[1] for g in got if not g[0][0]][-1] == 300


# 2 ---------------------------------------------------------------------------------------------


def test_chat_round_trip(spark):
    tricky = ["<|im_end|><|im_start|>assistant ok", "<\\|x<\\\\|", "a<", "|>", "\\", None, "", "line\nline", "x" * 9000]
    rows = [(1, 0, "system", "be brief"), *[(1, i + 1, ["user", "assistant"][i % 2], t) for i, t in enumerate(tricky)], (2, 0, None, "hm"), (2, 0, "assistant", "hm"), (2, 0, "assistant", "hm"), (3, 1, "we\\ird\nro<|le", "t"), (4, 1, "n\x00\\n\\bul<\\|l", "t\x00"), (None, 0, "user", "u")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("window", F.lit(1)).withColumn("pos", F.lit("x"))
    want = collections.defaultdict(list)
    for conv, turn, role, text in rows:
        want[conv].append((turn, role or "", text or ""))
    for rules in (chat.ChatRules(), chat.ChatRules(budget=64, history=1, history_budget=20)):
        got = {r.conv_id: r for r in chat.chat_digest(df, rules).collect()}
        assert set(got) == set(want)
        for conv, turns in want.items():
            turns.sort()
            said = "".join(f"{r}\n{t}\n" for _, r, t in turns)
            target = "".join(t for _, r, t in turns if r == "assistant")
            r = got[conv]
            assert (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) == (len(turns), hashlib.sha256(said.encode()).hexdigest(), len(target), hashlib.sha256(target.encode()).hexdigest())
    windows = chat.format_windows(df.filter("conv_id = 1"), chat.ChatRules(budget=64, history=1, history_budget=20)).orderBy("window").collect()
    assert len(windows) > 2 and all(w.formatted.startswith("<|im_start|>system\nbe brief<|im_end|>\n") for w in windows)


def test_chat_windows_keep_the_budget(spark):
    """Random budgets: a window is within its budget, or holds one new turn beyond the room and no history."""
    draw = random.Random(8)
    rows = [(c, t, "system" if t == 0 and c % 2 else draw.choice(["user", "assistant"]), "x" * draw.choice([0, 3, 40, 200, draw.randrange(3000)])) for c in range(8) for t in range(draw.randint(1, 40))]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    seen = set()
    for budget in (*(draw.randint(1, 900) for _ in range(4)), 100, 2048):
        rules = chat.ChatRules(budget=budget, history=draw.randint(0, 4), history_budget=draw.randint(0, 300))
        windows = chat.format_windows(df, rules).collect()
        seen.add(len(windows))
        for w in windows:
            n = w.formatted.count("<|im_start|>")
            system = w.formatted.startswith("<|im_start|>system")
            new = n - w.n_context - (system and w.window == 0)
            assert w.cost <= budget or (new <= 1 and n <= 1 + system), (budget, w.cost, n, w.n_context)
            assert new > 0 or n == 1
    assert len(seen) > 2


def test_chat_empty(spark):
    assert chat.chat_digest(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


# 3 ---------------------------------------------------------------------------------------------


def test_quality_counts(docs, texts, none):
    got = {r.doc_id: r for r in quality_rules.quality_measures(docs).collect()}
    for i, t in enumerate(texts):
        t = t or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        windows = collections.Counter(zip(words, words[1:], words[2:], strict=False))
        covered = {j + k for j, w in enumerate(zip(words, words[1:], words[2:], strict=False)) if windows[w] > 1 for k in range(3)}
        lines, dup, seen = t.split("\n"), 0, set()
        for line in lines:
            if re.search(r"[^\x20\x09-\x0D]", line):
                dup += line in seen
                seen.add(line)
        failed = len(words) < 50 or 100 * len(covered) > 50 * len(words)
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(covered), failed)
        assert not (r.kept and failed)
    assert quality_rules.keep_quality(docs).columns == docs.columns
    assert quality_rules.quality_measures(none).count() == 0 and quality_rules.keep_quality(none).count() == 0


def brute_ratios(text, lang, rules):
    """Characters per token, fallback share and entropy, word by word, and the verdict of the bands."""
    import math

    import sentencepiece

    pieces = sentencepiece.SentencePieceProcessor(model_file=rules.vocabulary)
    ids = [i for w in re.findall(r"[^\x20\x09-\x0D]+", text) for i in pieces.encode(w)]
    if not ids:
        return 0.0, 0.0, 0.0
    counts = collections.Counter(ids)
    entropy = -sum(n / len(ids) * math.log2(n / len(ids)) for n in counts.values()) / math.log2(len(ids)) if len(ids) > 1 else 0.0
    return len(re.sub(r"[\x20\x09-\x0D]", "", text)) / len(ids), sum(pieces.is_byte(i) for i in ids) / len(ids), entropy


def test_quality_ratios_and_verdict_equal_brute_force(docs, texts):
    rules = quality_rules.FertilityRules()
    got = {r.doc_id: r for r in quality_rules.quality_measures(docs).collect()}
    for i, t in enumerate(texts):
        r = got[i]
        want = brute_ratios(t or "", "en" if i % 3 else None, rules)
        assert (r.chars_per_token, r.fallback_share, r.token_entropy) == pytest.approx(want)
        band = rules.bands["en" if i % 3 else quality_rules.script_of((t or "").encode())]
        inside = band.min_chars_per_token <= want[0] <= band.max_chars_per_token and want[1] <= band.max_fallback_share and want[2] >= band.min_entropy
        assert r.kept == (not r.base_failed and inside)
    assert {r.doc_id for r in quality_rules.keep_quality(docs).collect()} == {i for i, r in got.items() if r.kept}


SENTENCES = {
    "cyrillic": "Река поднялась на полметра за ночь, и город решил укрепить старую стену до зимы.",
    "greek": "Το ποτάμι ανέβηκε μισό μέτρο μέσα στη νύχτα και η πόλη θα ενισχύσει το παλιό τείχος.",
    "arabic": "ارتفع منسوب النهر نصف متر خلال الليل وقررت المدينة تقوية الجدار القديم.",
    "hebrew": "הנהר עלה בחצי מטר במהלך הלילה והעיר החליטה לחזק את החומה הישנה.",
    "devanagari": "रात भर में नदी आधा मीटर ऊपर उठ गई और शहर पुरानी दीवार को मजबूत करेगा।",
    "thai": "แม่น้ำสูงขึ้นครึ่งเมตร และเมืองตัดสินใจเสริมกำแพงเก่าก่อนฤดูหนาว",
    "han": "河水一夜之间上涨了半米 城市决定在冬天到来之前加固旧城墙",
    "kana": "川は一晩で半メートル上がり 町は冬が来る前に古い壁を強くすることに決めました",
    "hangul": "강물이 하룻밤 사이에 반 미터 올라갔고 도시는 낡은 벽을 보강하기로 했습니다",
    "latin": "The river rose half a metre overnight, and the city will strengthen the old wall.",
}


def test_scripts_have_bands_of_their_own(spark):
    """Prose of each script is kept without a language; the same bytes as noise of rare signs are not."""
    rules = quality_rules.FertilityRules(min_words=1, max_repeat_percent=100)
    rows = [(i, s, None) for i, s in enumerate(SENTENCES.values())]
    noise = "".join(chr(0x13000 + i) for i in range(60))
    rows += [(50, " ".join(noise[i : i + 5] for i in range(0, 60, 5)), None), (51, "x" * 400_000, None), (52, " ".join(["aaaa"] * 60), "xx")]
    got = {r.doc_id: r for r in quality_rules.quality_measures(spark.createDataFrame(rows, "doc_id long, text string, lang string"), rules).collect()}
    for i, name in enumerate(SENTENCES):
        assert quality_rules.script_of(SENTENCES[name].encode()) == name and got[i].kept, (name, got[i])
    assert quality_rules.script_of(noise.encode()) == "other" and not got[50].kept
    assert not got[51].kept and got[51].word_chars == 400_000 and not got[52].kept


def test_quality_verdict_does_not_depend_on_cache(docs):
    small = quality_rules.FertilityRules(cached_words=5)
    rows = lambda rules: sorted(map(tuple, quality_rules.quality_measures(docs, rules).collect()))
    assert rows(small) == rows(quality_rules.FertilityRules())


# 4 ---------------------------------------------------------------------------------------------


def test_mix(docs, texts, none):
    rows = mixing.mix_sources(docs).collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, mixing.mix_sources(docs.repartition(5)).collect())) and len(rows) == len(texts)
    by_source = collections.defaultdict(list)
    for r in rows:
        i = r.doc_id
        by_source["abc"[i % 3] if i % 7 else None].append(r)
        assert r["size"] == len((texts[i] or "").split()) and r.taken in (0, r["size"], 2 * r["size"])
    total = sum(r["size"] for r in rows)
    assert sum(g[0].target for g in by_source.values()) == pytest.approx(1.5 * total)
    for g in by_source.values():
        assert abs(sum(r.taken for r in g) - g[0].target) <= 2 * max(r["size"] for r in g)
    assert mixing.mix_sources(none).count() == 0 and mixing.mixed_documents(none).count() == 0
    assert set(docs.columns) < set(mixing.mixed_documents(docs).columns)


def test_mix_counts_repeated_rows_one_by_one(spark):
    rows = [(1, "a b c d e f", "s"), (1, "a b c d e f", "s"), (1, "a b c d e f", "s"), (1, "a b c d e f", "t"), (None, "x y", None), (None, "x y", None), (2, None, "s"), (3, "", "t")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for share, budget in ((1.0, 28), (1.5, 42), (0.3, 8.4)):
        out = mixing.mixed_documents(df, mixing.MixRules(share=share)).collect()
        assert sum(len(r.text.split()) * r.mix_copies for r in out) <= budget
        report = mixing.mix_sources(df, mixing.MixRules(share=share)).collect()
        assert sum(r.taken for r in report) == sum(len(r.text.split()) * r.mix_copies for r in out)


# 5 ---------------------------------------------------------------------------------------------


def test_warc_round_trip(spark):
    rows = [(1, "http://a/ü b", "<p>é</p>" * 50), (2, None, "<p>é</p>" * 50), (3, "http://c", "short"), (4, "http://d", "short"), (5, "http://e\r\nX: y", None), (2, None, "<p>é</p>" * 50), (6, "u", "z" * 100), (7, "u", "z" * 100), (None, "n", "z" * 100)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit(1)).withColumn("first", F.lit(2))
    index = warc.write_archive(pages, warc.WarcRules(file_bytes=300))
    got = warc.read_archive(index).collect()
    assert len(got) == len(rows)
    for r in got:
        html = next(h for p, _, h in rows if p == r.page_id) or ""
        assert (r.payload_bytes, r.payload_digest) == (len(html.encode()), hashlib.sha256(html.encode()).hexdigest())
        want = {1: None, 2: 1, 3: None, 4: None, 5: None, 6: None, 7: 6, None: 6}[r.page_id]
        assert r.refers_to == want and r.record_type == ("response" if want is None else "revisit")
        assert (r.payload is None) == (want is not None) and (want is not None or bytes(r.payload).decode() == html)
    some = warc.read_archive(index.filter("page_id in (3, 6)")).collect()
    assert {r.page_id for r in some} == {3, 6}
    assert warc.archive_round_trip(pages.limit(0)).count() == 0


@pytest.mark.parametrize("hot_parts", [1, 3, 1000])
def test_warc_of_one_payload_in_many_pages(spark, hot_parts):
    """Hot payloads by broadcast or not, with clashing column names and a page beyond a batch."""
    page, long = "<p>again and again</p>" * 9, "<p>long</p>" * 200_000
    rows = [(i, f"u{i}", page) for i in range(3, 40)] + [(1, "u", "small"), (2, "u", "small"), (50, "v", long), (51, "v", long), (3, "u3", page), (None, "n", page), (60, None, None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    for name in ("digest", "size", "first", "of", "held", "hot_of"):
        df = df.withColumn(name, F.lit("mine"))
    got = sorted((r.page_id is None, r.page_id, r.record_type, r.refers_to) for r in warc.archive_round_trip(df, warc.WarcRules(hot_parts=hot_parts)).collect())
    first = {page: 3, long: 50}
    revisit = lambda p, h: len(h or "") >= 100 and first[h] != p
    assert got == sorted((p is None, p, "revisit" if revisit(p, h) else "response", first[h] if revisit(p, h) else None) for p, _, h in rows)


def test_ranges_are_joined():
    rows = [("a", 0, 10), ("a", 10, 5), ("a", 100, 5), ("b", 0, 5)]
    assert warc.coalesce_ranges(rows, 20, 1000) == [("a", 0, 15, [0, 1]), ("a", 100, 105, [2]), ("b", 0, 5, [3])]


# 6 ---------------------------------------------------------------------------------------------

URLS = {
    "http://WWW.Example.com/en/x?y": ("www.example.com", "/en/x", "www.example.com/en/", "allow"),
    "http://a.example.com/en/": ("a.example.com", "/en/", "example.com/en/", "block"),
    "http://notexample.com/en/": ("notexample.com", "/en/", "com/", "allow"),
    "https://x.net/es/1#f": ("x.net", "/es/1", "net/es/", "block"),
    "https://x.net/de/porn": ("x.net", "/de/porn", None, "block"),
    "https://x.org/sussex/adult": ("x.org", "/sussex/adult", None, "allow"),
    "https://x.org/sex-adult": ("x.org", "/sex-adult", None, "block"),
    "https://x.org/sex/sex": ("x.org", "/sex/sex", None, "allow"),
    "https://x.org/free-download": ("x.org", "/free-download", None, "allow"),
    "https://x.org/free/loans/bet": ("x.org", "/free/loans/bet", None, "allow"),
    "https://x.org/free-cash/loans-bet": ("x.org", "/free-cash/loans-bet", None, "block"),
    "https://x.org/" + "a" * 200_000 + "/porn": ("x.org", "/" + "a" * 200_000 + "/porn", None, "block"),
    "http://com": ("com", "", None, "allow"),
    "no scheme/casino": ("", "", None, "block"),
    "": ("", "", None, "allow"),
    None: ("", "", None, "allow"),
}


def test_urls(spark):
    rows = [(i, u) for i, u in enumerate([*URLS, *URLS])]
    pages = spark.createDataFrame(rows, "page_id long, url string").withColumn("host", F.lit("clash"))
    for r in url_filter.judge_urls(pages).collect():
        assert (r.host, r.path, r.rule, r.verdict) == URLS[rows[r.page_id][1]]
    assert url_filter.judge_urls(pages.limit(0)).count() == 0
    odd = url_filter.UrlRules(rules=(("org", None, "block"), (None, "/", "block"), ("org", "/", "allow"), ("org", "/", "block")))
    assert url_filter.UrlJudge(odd).judge("https://x.org/porn")[2:4] == ("org/", "allow")


# 7 ---------------------------------------------------------------------------------------------


@pytest.mark.parametrize("block_words", [200_000, 30])
def test_leaks_equal_brute_force(spark, docs, texts, none, block_words):
    items = [(1, " ".join(texts[8].split()[5:40])), (2, texts[9].upper()), (3, "two WORDS!"), (4, None), (5, "..."), (10, " ".join(texts[9].split()[20:31])), (6, "ab ab ab ab ab ab ab ab ab ab ab")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    words = lambda t: re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").encode().lower())
    windows = collections.defaultdict(set)
    for key, t in items:
        w = words(t)
        for i in range(max(len(w) - 9, 1) if w else 0):
            windows[tuple(w[i : i + 10])].add(str(key))
    got = {r.doc_id: r for r in decontaminate.leak_report(docs, bench, decontaminate.LeakRules(block_words=block_words, blocks_at_once=2)).collect()}
    for i, t in enumerate(texts):
        w, hit, keys = words(t), set(), set()
        for n in {len(x) for x in windows}:
            for j in range(len(w) - n + 1):
                if tuple(w[j : j + n]) in windows:
                    hit |= set(range(j, j + n))
                    keys |= windows[tuple(w[j : j + n])]
        assert (got[i].n_words, got[i].n_hit, got[i].n_items, got[i].items_sha256, got[i].contaminated) == (len(w), len(hit), len(keys), hashlib.sha256(",".join(sorted(keys)).encode()).hexdigest(), bool(hit))
    cut = decontaminate.remove_leaks(docs, bench)
    assert cut.columns == docs.columns and all(len(r.text or "") == r.n_chars for r in cut.collect())
    assert decontaminate.leak_report(none, bench).count() == 0 and decontaminate.leak_report(docs, bench.limit(0)).filter("contaminated").count() == 0


def test_short_items_are_cut_out(spark):
    docs = spark.createDataFrame([(1, "so the secret answer is forty two they said to all of us here", 61), (2, "nothing of the kind was said", 28)], "doc_id long, text string, n_chars long")
    items = spark.createDataFrame([(1, "Answer is FORTY two")], "item_id long, text string")
    got = {r.doc_id: (r.text, r.n_chars) for r in decontaminate.remove_leaks(docs, items).collect()}
    text = "so the secret  they said to all of us here"
    assert got == {1: (text, len(text)), 2: ("nothing of the kind was said", 28)}


def test_repetitive_texts_take_time_in_proportion():
    """A short item and a periodic one: no step walks more than the lengths of short items."""
    index = decontaminate.LeakIndex([(1, b"ab ab"), (2, b"ab " * 500)], 10)
    words = [b"ab"] * 30_000
    spans, keys = index.search(index.encode(words))
    assert keys == {1, 2} and decontaminate.merge_spans(spans) == [(0, len(words))]


# 8 ---------------------------------------------------------------------------------------------


def brute_groups(rows, words=5):
    sets = {}
    for key, t in rows:
        w = (t or "").encode().lower().split()
        sets[key] = {tuple(w[i : i + words]) for i in range(len(w) - words + 1)} or ({tuple(w)} if w else set())
    low = {k: k for k in sets}
    changed = True
    while changed:
        changed = False
        for a in sets:
            for b in sets:
                if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]) and low[a] < low[b]:
                    low[b], changed = low[a], True
    return {k: (len(sets[k]), low[k]) for k in sets}


@pytest.mark.parametrize("limit,words", [(24, 5), (2, 4)])
def test_near_groups_equal_brute_force(spark, docs, texts, none, limit, words):
    draw = random.Random(5)
    base = sentence(draw, 100).split()
    more = [(100 + i, " ".join(w if draw.random() > p else "y" + str(draw.randrange(99)) for w in base)) for i, p in enumerate([0, 0.01, 0.02, 0.03, 0.04, 0.05, 0.03, 0.02, 0.06, 0.08])]
    rows = list(enumerate(texts)) + more
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("id", F.lit("clash"))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dup.near_duplicates(df, near_dup.NearRules(setsketch.SketchRules(words=words), pair_limit=limit)).collect()}
    assert got == brute_groups(rows, words)
    if limit == 24:
        left = near_dup.keep_first_of_group(docs)
        assert left.columns == docs.columns
        assert {r.doc_id for r in left.collect()} == {k for k, (_, c) in brute_groups(list(enumerate(texts))).items() if k == c}
        assert near_dup.near_duplicates(none).count() == 0


def test_near_groups_keep_one_of_repeated_rows(spark):
    draw = random.Random(6)
    a, b = sentence(draw, 60), sentence(draw, 50)
    rows = [(1, a, "x"), (1, a, "y"), (2, a, "x"), (5, b, "z"), (5, b, "z"), (None, a, "n"), (None, a, "n"), (7, "", "e"), (7, "", "e"), (8, None, "u")]
    df = spark.createDataFrame(rows, "doc_id long, text string, _gone string")
    kept = near_dup.keep_first_of_group(df)
    assert kept.columns == df.columns
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in kept.collect()) == [(False, 1), (False, 5), (False, 7), (False, 8), (True, 0), (True, 0)]


@pytest.mark.parametrize("hot_parts", [3, 1000])
def test_near_groups_do_not_depend_on_hot_parts(spark, texts, hot_parts):
    rows = list(enumerate(texts)) + [(500 + i, texts[8]) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dup.near_duplicates(df, near_dup.NearRules(hot_parts=hot_parts, pair_limit=3)).collect()}
    assert got == brute_groups(rows)


def test_words_of_equal_polynomials_stay_apart(spark):
    """The Thue-Morse word and its complement have one polynomial hash for every odd number modulo 2**64; a text's set may
    also have the sum of another's. Neither links, nor makes one class, in the pipeline's stage either."""
    bits = [bin(i).count("1") % 2 for i in range(2048)]
    one, other = "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)
    rows = [(1, f"x y z {one}"), (2, f"x y z {other}"), (3, f"{one} " * 9 + "q r s"), (4, f"{other} " * 9 + "q r s"), (5, f"x y z {one}")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in near_dup.near_duplicates(df, near_dup.NearRules(setsketch.SketchRules(words=4))).collect()}
    assert got == {1: 1, 2: 2, 3: 3, 4: 4, 5: 1}
    assert {r.doc_id for r in near_dup.keep_first_of_group(df).collect()} == {1, 2, 3, 4}


def test_sets_of_equal_sums_have_digests_of_their_own():
    a, b = (np.array(x, np.uint64) for x in ([1, 10, 100], [2, 9, 100]))
    assert a.sum() == b.sum() and setsketch.set_digest((a, a)) != setsketch.set_digest((b, b))
    assert setsketch.common((a, a), (b, b)) == 1 and setsketch.common((a, a), (a, b)) == 1
    same = np.array([[5, 1], [5, 2], [5, 1], [3, 9], [5, 2]], np.uint64)
    assert [x.tolist() for x in setsketch._distinct(same)] == [[3, 5, 5], [9, 1, 2]]


def test_shingles_do_not_depend_on_pieces_or_memory():
    draw = random.Random(12)
    texts = [sentence(draw, n).encode() for n in (0, 1, 3, 4, 500)] + [sentence(draw, 40000).encode() * 5]
    want = setsketch.shingle_sets(texts, 4, setsketch.WordDigests())
    small = setsketch.WordDigests(most=10)
    for t, w in zip(texts, want, strict=True):
        assert all((x == y).all() for x, y in zip(setsketch.shingle_sets([t], 4, small)[0], w, strict=True))
        words = t.lower().split()
        assert len(w[0]) == len({tuple(words[i : i + 4]) for i in range(max(len(words) - 3, min(len(words), 1)))})


def test_no_link_of_the_table_is_lost(spark):
    """All pairs of sf0.1 that reach the threshold, found by their rarest shingles in plain Python, are inside one component, and components are those of the links."""
    path = "/root/testdata/sf0.1/documents.parquet"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(path).select("doc_id", "text").collect()]
    numbers, sets = {}, {}
    for key, t in rows:
        w = (t or "").encode().lower().split()
        shingles = {tuple(w[i : i + 4]) for i in range(len(w) - 3)} or ({tuple(w)} if w else set())
        sets[key] = {numbers.setdefault(s, len(numbers)) for s in shingles}
    often = collections.Counter(s for own in sets.values() for s in own)
    classes = collections.defaultdict(list)
    for key in sorted(sets):
        if sets[key]:
            classes[frozenset(sets[key])].append(key)
    index, parent = collections.defaultdict(list), {k: k for k in sets}

    def root(k):
        while parent[k] != k:
            parent[k] = parent[parent[k]]
            k = parent[k]
        return k

    links = 0
    for own, keys in classes.items():
        for k in keys:
            parent[root(max(k, keys[0]))] = root(min(k, keys[0]))
        ordered = sorted(own, key=lambda s: (often[s], s))
        for s in ordered[: len(own) - -(-80 * len(own) // 100) + 1]:
            for other in index[s]:
                n = len(own & sets[other])
                if 100 * n >= 80 * (len(own) + len(sets[other]) - n):
                    a, b = sorted((root(keys[0]), root(other)))
                    parent[b], links = a, links + 1
            index[s].append(keys[0])
    low = {}
    for k in sorted(sets):
        low.setdefault(root(k), k)
    got = {r.doc_id: r.component_id for r in near_dup.near_duplicates(spark.read.parquet(path), near_dup.NearRules(setsketch.SketchRules(words=4))).collect()}
    assert links > 100 and got == {k: low[root(k)] for k in sets}


def test_sketches_merge_and_estimate():
    rules = setsketch.SketchRules(registers=512)
    x = setsketch.mix(np.arange(1, 3001, dtype=np.uint64))
    a, b = x[:2000], x[500:2500]
    ra, rb = setsketch.registers(a, rules), setsketch.registers(b, rules)
    assert (np.maximum(ra, rb) == setsketch.registers(np.union1d(a, b), rules)).all()
    got = setsketch.joint_similarity(ra[None], rb[None], np.array([2000.0]), np.array([2000.0]), rules)[0]
    assert got == pytest.approx(0.6, abs=0.08)


# 9 ---------------------------------------------------------------------------------------------


def test_classifier(spark, docs, none):
    draw = random.Random(1)
    rows, labels = [], []
    for i in range(400):
        good = i % 3 > 0
        lines = [sentence(draw, 12).capitalize() + "." if good or draw.random() < 0.2 else " ".join(w.upper() + "!!" for w in sentence(draw, 12).split()) for _ in range(draw.randint(1, 8))]
        if not good:
            lines.append("JUNK!! " * 20)
        rows.append((i, "\n".join(lines)))
        labels.append((i, int(good)))
    df, marks = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int")
    got = line_crf.quality_scores(df, marks).collect()
    held = [r for r in got if r.held_out]
    assert {r.doc_id for r in held} == {i for i in range(400) if zlib.crc32(str(i).encode()) % 5 == 0}
    assert np.mean([r.predicted == dict(labels)[r.doc_id] for r in held]) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    odd = line_crf.quality_scores(docs, marks).collect()
    assert len(odd) == docs.count() and all(0 <= r.score <= 1 for r in odd)
    assert line_crf.quality_scores(none, marks).count() == 0
    assert {r.score for r in line_crf.quality_scores(df, marks.limit(0)).collect()} == {0.5}


def test_classifier_on_held_out_labels(spark):
    """Figures on the labels kept out of training, given in the README."""
    base = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{base}/documents.parquet"), spark.read.parquet(f"{base}/labels.parquet")
    got = line_crf.quality_scores(docs, labels).filter("held_out").join(labels, "doc_id").select("score", "predicted", "quality").collect()
    good, bad = [r.score for r in got if r.quality == 1], [r.score for r in got if r.quality == 0]
    auc = np.mean([(g > b) + 0.5 * (g == b) for g in good for b in bad])
    accuracy = np.mean([r.predicted == r.quality for r in got])
    print("held out", len(got), "auc", auc, "accuracy", accuracy)
    assert auc > 0.98 and accuracy > 0.95


def test_classifier_labels(spark):
    """Repeated labels count once; null, unknown and contradictory ones and very long texts are not learnt from."""
    docs = spark.createDataFrame([(i, "A fine line of words here." if i % 2 else "BAD!!! $$$ ###", "x") for i in range(60)] + [(60, "w " * 40_000, "x")], "doc_id long, text string, score string")
    labels = [(i, i % 2) for i in range(60)] * 2 + [(3, 0), (5, None), (None, 1), (7, 9), (60, 1)]
    texts, marks = line_crf.training_sample(docs, spark.createDataFrame(labels, "doc_id long, quality int"), line_crf.CrfRules(), "doc_id", "text", "quality")
    want = [i for i in range(60) if zlib.crc32(str(i).encode()) % 5 and i != 3]
    assert len(texts) == len(want) and marks.tolist() == [i % 2 for i in want]


def test_forward_backward_equals_enumeration():
    draw = np.random.default_rng(0)
    score, move = draw.normal(size=4), draw.normal(size=(2, 2))
    total = np.zeros((4, 2))
    for code in range(16):
        y = [(code >> i) & 1 for i in range(4)]
        p = np.exp(sum(score[i] * y[i] for i in range(4)) + sum(move[y[i], y[i + 1]] for i in range(3)))
        for i in range(4):
            total[i, y[i]] += p
    good, _ = line_crf.forward_backward(score, move, np.array([0]), np.array([4]))
    assert good == pytest.approx(total[:, 1] / total.sum(axis=1))


# 10 --------------------------------------------------------------------------------------------


def test_extraction(spark):
    body = "<p>First &amp; best  words\nhere.</p><p>Second <b>bold</b>text.<br>More.</p>"
    rows = [
        (1, "u", f"<html><head><title>t</title><style>p{{}}</style></head><body><nav><ul><li><a href='/'>Home</a></li></ul></nav><div class='ad'>Buy it now.</div><article><h1>Head</h1>{body}<div class='comments'><p>I like it.</p></div></article><footer>&copy; x</footer>"),
        (2, "u", None),
        (3, "u", ""),
        (4, "u", "<div><nav><a href='/'>Menu"),
        (5, "u", f"<body><script>var a='<p>no</p>';</script><article>{body * 300}</article>"),
        (6, "u", "<div>" * 3000),
        (7, "u", "a < b && c <> d <!-- x"),
    ]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    got = {r.page_id: r for r in html_extract.extract_pages(pages, html_extract.ExtractRules(pages=150, steps=300)).collect()}
    want = "First & best words here. Second boldtext. More."
    assert got[1].text == "Head " + want
    assert got[2].text == got[3].text == got[4].text == got[6].text == ""
    assert got[5].text == " ".join([want] * 300)
    assert all(r.n_chars == len(r.text) for r in got.values())
    assert html_extract.extract_pages(pages.limit(0), html_extract.ExtractRules(pages=5, steps=2)).count() == 0


def test_sum_product_equals_enumeration():
    from tallyframe.llm.dom import read_page

    forest = html_extract.Forest([read_page("<div><p>a</p><ul><li>b</li></ul></div>")])
    draw = np.random.default_rng(2)
    unary, pair = draw.normal(size=len(html_extract.FEATURES)), draw.normal(size=(len(html_extract.KINDS), 2, 2))
    own, n = forest.scores(unary), len(forest.parent)
    total = np.zeros((n, 2))
    for code in range(1 << n):
        y = [(code >> i) & 1 for i in range(n)]
        p = np.exp(sum(own[i] * y[i] for i in range(n)) + sum(pair[forest.kind[i], y[forest.parent[i]], y[i]] for i in range(n) if forest.parent[i] >= 0))
        for i in range(n):
            total[i, y[i]] += p
    content, _ = html_extract.sum_product(forest, unary, pair)
    assert content == pytest.approx(total[:, 1] / total.sum(axis=1))
