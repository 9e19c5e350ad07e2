"""Relevance, sentences and summaries of press articles."""

import pytest
from pyspark.sql import functions as F

from tidemark.functions import press_text
from tidemark.operators import scoring

# (title, body, is_relevant, category, needs_manual_review); category "*" = any.
RELEVANCE = [
    ("", "", False, "classification_failed", False),
    ("   ", "   ", False, "classification_failed", False),
    ("人事異動のお知らせ", "取締役の変更について", False, None, False),
    ("2025年度決算報告", "株主の皆様へ配当のご案内", False, None, False),
    ("不動産セミナー開催", "展示会のお知らせ", False, None, False),
    ("CSR活動報告", "SDGs達成に向けた取り組み", False, None, False),
    ("オフィス移転のお知らせ", "新オフィスについて", False, None, False),
    ("新機能リリースのお知らせ", "本日より新サービスの提供開始いたします。機能追加により使いやすくなりました。", True, "service_feature", False),
    ("不動産市場調査レポート公開", "最新の統計データに基づくトレンド分析。市場動向をまとめた白書を発行。", True, "market_data", False),
    ("サイトリニューアルのお知らせ", "UI/UXデザインを刷新し、ユーザビリティを大幅に改善しました。", True, "ux_improvement", False),
    ("料金プラン改定のお知らせ", "新しい価格プランを導入します。一部機能を無料で提供開始。", True, "pricing", False),
    ("お知らせ", "弊社に関する重要なお知らせです。", True, "other", True),
    ("一般的なお知らせ", "本日ある調査を公開しました。", True, "other", True),
    ("新機能リリースとイベント開催", "新サービスの提供開始に伴い、機能追加のアップデートを行いました。", True, "service_feature", False),
    ("新サービスリリース", "新機能をリリースしました。", True, "service_feature", False),
    (None, "料金と価格のプラン", True, "pricing", False),
]


def test_relevance(spark):
    rows = spark.createDataFrame(
        [(i, t, b) for i, (t, b, *_) in enumerate(RELEVANCE)], "id int, title string, body_text string"
    )
    got = {r.id: r for r in scoring.classify_articles(rows).collect()}
    for i, (title, _, relevant, category, review) in enumerate(RELEVANCE):
        assert got[i].is_relevant is relevant, title
        assert got[i].relevance_category == category, title
        assert got[i].needs_manual_review is review, title
    assert got[12].confidence == pytest.approx(1 / 9)


def test_write_back(spark):
    rows = spark.createDataFrame([(1, "新機能", ""), (2, "", ""), (3, "決算", "x")], "id int, title string, body_text string")
    got = {r.id: r for r in scoring.written_back(scoring.classify_articles(rows)).collect()}
    assert (got[1].classification, got[1].needs_manual_review, got[1].summary) == ("relevant", True, None)
    assert got[2].classification == "classification_failed" and got[3].classification == "irrelevant"


CUTS = [
    ("短いテキスト。", 200, "短いテキスト。"), ("あ" * 200, 200, "あ" * 200),
    ("最初の文。二番目の文。三番目の文は長いです。" + "あ" * 200, 30, "最初の文。二番目の文。三番目の文は長いです。"),
    ("すごい！これは長いテキストです。" + "あ" * 200, 5, "すごい！"), ("本当？これは長いテキストです。" + "あ" * 200, 5, "本当？"),
    ("あ" * 300, 200, "あ" * 200), ("", 200, ""),
]


def test_cut_at_sentence(spark):
    for text, length, want in CUTS:
        row = spark.range(1).select(press_text.cut_at_sentence(F.lit(text), length).alias("t")).first()
        assert row.t == want


SPLITS = [
    ("最初の文。二番目の文。", ["最初の文。", "二番目の文。"]), ("文一。文二！文三？", ["文一。", "文二！", "文三？"]),
    ("最初の文。残りのテキスト", ["最初の文。", "残りのテキスト"]), ("", []), (" 一。 \n 二 ", ["一。", "二"]),
]
KEYS = [
    ("当社は新機能を開発しました。これにより使いやすさが向上します。関係ないことです。", "service_feature", "新機能"),
    ("調査結果を発表しました。前年比で20%増加しています。その他の話。", "market_data", "調査"),
    ("料金プランを改定しました。月額500円から利用可能です。詳細はこちら。", "pricing", "料金"),
    ("何らかのテキストです。特にキーワードはありません。", "other", None), ("何らかのテキストです。", "unknown", None),
    ("", "service_feature", None),
]


def test_sentences_and_keys(spark):
    rows = spark.createDataFrame(SPLITS, "t string, w array<string>")
    for r in rows.select("w", press_text.sentences(F.col("t")).alias("s")).collect():
        assert r.s == r.w
    rows = spark.createDataFrame(KEYS, "t string, c string, w string")
    got = rows.select("w", press_text.key_sentences(press_text.sentences(F.col("t")), F.col("c")).alias("k")).collect()
    for r in got:
        assert (any(r.w in s for s in r.k)) if r.w else r.k == []


def brute_summary(body, keywords):
    """The rule stated step by step, for comparison."""
    text = body.strip()
    if len(text) <= 200:
        return text
    parts, current = [], ""
    for char in text:
        current += char
        if char in "。！？":
            parts, current = parts + [current.strip()], ""
    parts = [p for p in [*parts, current.strip()] if p]

    def cut(t):
        if len(t) <= 200:
            return t
        head = t[:200]
        at = max(head.rfind(c) for c in "。！？")
        return head[: at + 1] if at >= 0 else head

    if len(parts[0]) > 200:
        return cut(parts[0])
    out = parts[0]
    for s in (p for p in parts if any(k in p for k in keywords)):
        if s == parts[0]:
            continue
        if len(out + s) > 200:
            break
        out += s
    if len(out) < 50:
        for s in parts[1:]:
            if s in out:
                continue
            if len(out + s) > 200:
                out = cut(out + s)
                break
            out += s
            if len(out) >= 50:
                break
    return out


def test_summaries_against_brute_force(spark):
    import random

    from tidemark.rules.press import SUMMARY_KEYWORDS

    random.seed(7)
    words = ["新機能", "調査", "料金", "物件", "検索", "あ" * 60, "改善", "の", "です", "。", "！", "？", " "]
    bodies = ["", "   ", "あ" * 80, "短い文。", "新機能をリリースしました。" * 50, "あ" * 250 + "。次の文。", "あ" * 200, "あ" * 50]
    bodies += ["".join(random.choice(words) for _ in range(random.randint(5, 90))) for _ in range(150)]
    cases = [(b, random.choice(list(SUMMARY_KEYWORDS))) for b in bodies]
    rows = spark.createDataFrame([(i, b, c) for i, (b, c) in enumerate(cases)], "id int, body_text string, relevance_category string")
    for r in press_text.add_press_summary(rows).collect():
        assert r.summary == brute_summary(r.body_text, SUMMARY_KEYWORDS[r.relevance_category]), r.body_text
        assert len(r.summary) <= 200


def test_full_width_digits_and_wide_spaces(spark):
    from tidemark.functions import dates
    from tidemark.rules import normalise, structure

    rows = spark.createDataFrame([("２０２５年１月５日",), ("x 2025/1/5",), ("２０２５.０１.０５",), ("none",)], "t string")
    got = [(r.a, r.b) for r in rows.select(dates.date_from_text(F.col("t")).alias("a"), dates.date_from_head(F.col("t"), "mixed").alias("b")).collect()]
    assert got == [("2025-01-05", "2025-01-05")] * 3 + [(None, None)]
    texts = spark.createDataFrame([("残り３室",), ("残り　3室",), ("残り三室",)], "t string")
    assert [r[0] for r in texts.select(F.col("t").rlike(structure.URGENCY_TEXT)).collect()] == [True, True, False]
    noise = spark.createDataFrame([("５円",), ("5円",), ("五円",)], "t string")
    assert [r[0] for r in noise.select(F.col("t").rlike("|".join(normalise.LISTING_NOISE))).collect()] == [True, True, False]
