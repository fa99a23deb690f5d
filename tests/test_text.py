import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quarrylight.functions import gatetext as G
from quarrylight.functions import splitting as S
from quarrylight.functions import text as T
from quarrylight.functions import vocab as V
from quarrylight.operators import splits as P


def one(spark, value, fn, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(fn(F.col("v")).alias("o")).first().o


@pytest.mark.parametrize(
    "reply,score",
    [("Score: 4\nReasoning: fine", 4.0), ("Score: 3/5", 3.0), ("4\nbecause", 4.0), ('{"score": 2.5}', 2.5), ("none", 3.0), ("Score: 10", 5.0), ("Score: 0", 1.0)],
)
def test_judge_scores(spark, reply, score):
    assert one(spark, reply, T.judge_score) == score


@pytest.mark.parametrize(
    "answer,cited",
    [
        ("A [Source 2]. B [Source 1] [Source 2].", [1, 2]),
        ("A [3] and [25] and [1].", [1, 3]),
        ("No marks.\nSources: [Source 4] x", [4]),
        ("Body [Source 1].\nSources:\n[Source 2] y", [1]),
        ("plain", []),
    ],
)
def test_cited_numbers(spark, answer, cited):
    assert one(spark, answer, T.cited_numbers) == cited


def test_author_lines(spark):
    cases = {("Ann Lee",): "Lee", ("Ann Lee", "Bo Chen"): "Lee and Chen", ("A B", "C D", "E F"): "B, D, and F", ("A B", "C D", "E F", "G H"): "B et al.", (): "Unknown"}
    for names, line in cases.items():
        assert one(spark, list(names), T.author_line, "array<string>") == line


def test_section_names_and_ids(spark):
    assert one(spark, "3.1 Related Work:", T.section_name) == "related_work"
    assert one(spark, "IV. Méthode", T.section_name) == "m_thode"
    assert one(spark, "12", T.section_name) == "unnamed"
    assert one(spark, "arxiv_1706_03762", T.metric_paper_id) == "1706.03762"
    assert one(spark, "arXiv:1706.03762v5", T.merge_paper_id) == "1706.03762"
    assert one(spark, "cs/0506023", T.merge_paper_id) == "0506.023"


def test_paper_ids_of_more_than_five_digits(spark):
    got = [one(spark, raw, T.metric_paper_id) for raw in ("ArXiv_0001_100001", "2301_1234567", "2301_123")]
    assert got == ["0001.100001", "2301.1234567", "2301_123"]


def test_stem_and_intent(spark):
    assert one(spark, "generation", T.stem) == "gener"
    assert one(spark, "sing", T.stem) == "sing"
    assert one(spark, "What is attention?", T.query_intent) == "foundational"
    assert one(spark, "latest SOTA models", T.query_intent) == "recent"
    assert one(spark, "Compare A and B", T.query_type) == "multi_hop"
    assert one(spark, "Hello!!", T.is_casual) and not one(spark, "weather today", T.is_on_topic)


def test_acronyms(spark):
    got = one(spark, "Maximum Inner Product Search (MIPS). Word (YZ).", T.acronym_pairs)
    assert [(p.acronym, p.full_form) for p in got] == [("MIPS", "Maximum Inner Product Search")]


def test_acronym_runs_and_one_look_at_the_text(spark):
    long = "word " * 5000
    text = f"{long}Index\n Search-tree  \t(IST2), {long}. Alpha Beta (AB)(CD) a Gamma Delta (AB) e\u0301Word Run (TOOLONGACRONYM) x y (XY"
    got = [(p.acronym, p.full_form) for p in one(spark, text, T.acronym_pairs)]
    assert got == [("IST2", "rd word word word word word word Index\n Search-tree"), ("AB", "a Gamma Delta")]
    assert str(T.acronym_pairs(F.col("whole_text"))).count("whole_text") == 1


def test_unsupported_claims(spark):
    text = "The model has 12 layers in its architecture. It has 12 layers [Source 1] in the architecture. Short 5 loss."
    assert one(spark, text, T.unsupported_claims) == 1


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab .;,\n", max_size=400))
def test_recursive_split_keeps_every_word_character(text):
    chunks = S.recursive_split(text, 40, 8)
    assert all(0 < len(c) <= 40 for c in chunks)
    letters = [c for c in text if c in "ab"]
    joined = "".join(c for chunk in chunks for c in chunk if c in "ab")
    assert len(joined) >= len(letters)
    without = "".join(c for chunk in S.recursive_split(text, 40, 0) for c in chunk if c in "ab")
    assert without == "".join(letters)


def test_equations_are_not_cut():
    equation = "$$" + "x + y " * 30 + "$$"
    chunks = S.split_around_equations("word " * 20 + equation + " word" * 20, 60, 0)
    assert any(equation in c for c in chunks)


def test_semantic_split_at_a_topic_change(spark):
    rows = [(1, n, f"s{n}") for n in range(8)] + [(2, n, "same") for n in range(5)]
    frame = spark.createDataFrame(rows, "id long, nth int, sentence string")
    steps = frame.select("id", "nth", F.when((F.col("id") == 1) & (F.col("nth") >= 4), 1).otherwise(0).alias("bucket"), F.lit(1.0).alias("value"))
    gaps = P.topic_gaps(P.gap_similarity(steps, frame, "id"), "id").collect()
    assert (1, 4) in {(r["id"], r["gap"]) for r in gaps} and all(r["id"] == 1 for r in gaps)
    texts = spark.createDataFrame([(1, "See Dr. Who. It ends!"), (2, "  "), (3, None)], "id long, text string")
    assert [(r["id"], r["sentence"]) for r in P.sentences(texts, "id", "text").orderBy("id", "nth").collect()] == [(1, "See Dr. Who."), (1, "It ends!")]
    assert [r["chunk"] for r in P.semantic_chunks(texts, "id", "text").collect()] == ["See Dr. Who. It ends!"]


def test_semantic_chunks_are_dealt_out_once(spark):
    topics = ["red apples fall down.", "red apples fall far.", "cold rivers run north.", "cold rivers run deep."]
    texts = spark.createDataFrame([(n, " ".join(s for s in topics for _ in range(1 + n % 3))) for n in range(9)], "id long, text string")
    found = P.semantic_chunks(texts, "id", "text", low=10)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and len({r["id"] for r in found.collect() if r["ord"] > 0}) > 0
    by_rows = P.semantic_chunks(texts, "id", "text", embed=lambda rows, key: P.hashed_words(rows, key), low=10)
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, by_rows.collect()))


def test_pieces_are_packed_to_size(spark):
    pieces = ["a" * 50, "b" * 50, "c" * 10]
    runs = one(spark, pieces, lambda c: P.packed(c, 40, 200), "array<string>")
    assert [(r.first, r.last, r.size) for r in runs] == [(0, 0, 50), (1, 2, 61)]
    assert one(spark, "aa bb cc dddddddd e", lambda c: P.wrapped(c, 5)) == ["aa bb", "cc", "dddddddd", "e"]


def test_pdf_sections_and_preamble(spark):
    text = "Intro words " * 10 + "\n3.2\nScaled Attention\n" + "body " * 20 + "\nCONCLUSION\n" + "end " * 20
    frame = spark.createDataFrame([(1, text), (2, "short"), (3, None), (4, "x " * 80)], "id long, text string")
    got = P.pdf_sections(frame, "id", "text").orderBy("id", "ord").collect()
    assert [(r["id"], r["header"]) for r in got] == [(1, "preamble"), (1, "3.2 Scaled Attention"), (1, "CONCLUSION"), (2, "full_text"), (3, "full_text"), (4, "preamble")]
    assert got[1]["text"] == ("body " * 20).strip()
    chunks = [(1, "T — S\n\nHeading\nFigure 1: x\ngoes on\nReal sentence here."), (2, "no start"), (3, None), (4, "Table 2 a\n\nlower, it starts")]
    told = {r["id"]: r["text"] for r in P.strip_preambles(spark.createDataFrame(chunks, "id long, text string"), "id", "text").collect()}
    assert told == {1: "Real sentence here.", 2: "no start", 3: "", 4: "lower, it starts"} or told[4] == "Table 2 a\n\nlower, it starts"


@pytest.mark.parametrize(
    "bad,good",
    [("Ã©tÃ©", "été"), ("plain ∑ Î±", "plain ∑ α"), ("â†' âˆ' Ï² Ïµ Âµ ∑", "→ ∑ ρ ε μ ∑"), ("∑ Ï\x81 and Ï", "∑ ρ and ρ"), ("âˆž √", "∞ √"), (None, ""), ("Ã alone", "Ã alone")],
)
def test_encoding_repair(spark, bad, good):
    assert one(spark, bad, P.fix_encoding) == good


def test_acronym_expansion(spark):
    kind = "array<struct<acronym:string,full_form:string>>"
    frame = spark.createDataFrame(
        [("RL and RL", [("RL", "old"), ("RL", "Reinforcement Learning")]), ("Reinforcement Learning (RL) and RL", [("RL", "Reinforcement Learning")]), ("RLX", [("RL", "a$b")]), ("x", None)],
        f"t string, p {kind}",
    )
    got = [r.o for r in frame.select(P.expand_acronyms(F.col("t"), F.col("p")).alias("o")).collect()]
    assert got == ["Reinforcement Learning (RL) and RL", "Reinforcement Learning (RL) and RL", "RLX", "x"]


def verdicts(spark, question, text, title):
    from quarrylight.operators import gates

    asked = spark.createDataFrame([(1, question)], "query_id long, question string")
    rows = [(1, text.lower(), title.lower(), text.lower(), [(title, text)])]
    evidence = spark.createDataFrame(rows, "query_id long, body string, heads string, top string, papers array<struct<title:string,text:string>>")
    return gates.entity_verdicts(asked, evidence).first().entity_reason, gates.premise_verdicts(asked, evidence).first().premise_reason


@pytest.mark.parametrize(
    "question,text,title,entity,premise",
    [
        ("How does BERT work?", "BERT is a model. BERT has layers. BERT wins.", "x", "", ""),
        ("How does BERT use Quokka here?", "BERT is a model. BERT has layers. BERT wins.", "x", "absent_terms", ""),
        ("What is Quokka?", "BERT is a model.", "x", "no_terms", ""),
        ("What is Quokka?", "A quokka is there.", "x", "passing_mention", ""),
        ("Compare Quokka and Wombat", "A quokka is there.", "x", "", ""),
        ("What is RAG?", "nothing", "x", "", ""),
        ("What is InstructGPT-like training?", "We instruct, instruct and instruct.", "x", "", ""),
        ("BERT uses 500 billion parameters, right?", "BERT BERT BERT has 340", "bert", "", "unknown_number"),
        ("According to the lora paper, is it good?", "text", "bert", "", "paper_not_found"),
        ("What accuracy did the wombat model get on imagenet?", "the wombat model", "x", "", "unknown_claim"),
        ("according to the lora paper, does it hold when applied to protein folding?", "protein folding once", "lora", "", "rare_claim"),
        ("according to the lora paper, does it hold when applied to protein folding?", "protein folding " * 6, "lora", "", "no_joint_evidence"),
        ("according to the lora paper, does it hold when applied to protein folding?", "lora accuracy protein folding " * 6, "lora", "", ""),
    ],
)
def test_gates(spark, question, text, title, entity, premise):
    assert verdicts(spark, question, text, title) == (entity, premise)


def test_math():
    assert G.wrap_math("α_t and x^2 ≤ $y_1$") == r"$\alpha_{t}$ and $x^{2}$ $\leq$ $y_1$"
    assert G.wrap_math(r"\frac{a}{b} holds") == r"$\frac{a}{b}$ holds"
    assert G.wrap_math(r"\frac{a{b{c{d{e}}}}}{f}\sqrt{x}_i end") == r"$\frac{a{b{c{d{e}}}}}{f}\sqrt{x}_i$ end"
    assert G.wrap_math("iota_t beta_1 {") == r"iota_t $\beta_{1}$ {"
    assert G.wrap_math(r"\left( x \right) \frac{") == r"$\left($ x $\right) \frac$" + "{"


def test_fixed_lists_have_no_repeats():
    for words in (V.BM25_STOP, V.TITLE_STOP, V.OVERLAP_STOP, V.DOMAIN_TERMS, V.REFUSAL_PHRASES):
        assert len(words) == len(set(words))
    assert len(V.LANDMARK_PAPERS) == 30 and len(V.REFUSAL_PHRASES) == 26


def test_equation_lines_become_display_math(spark):
    cases = {
        r"Attention(Q, K, V) = softmax($\frac{QK^T}{\sqrt{d_k}}$)V": r"$$\text{Attention}(Q, K, V) = \text{softmax}(\frac{QK^T}{\sqrt{d_k}})V$$",
        "  y = $x$ [Source 1] [Source 2] ": "$$y = x$$ [Source 1] [Source 2]",
        "The loss is $L$ = the sum of all terms": None, "y = x": None, "$y$ is x": None, "# y = $x$": None, "- y = $x$": None, "* y = $x$": None,
        "$$y = x$$": None, "": None, "y = $x$" + " q" * 100: None, "1 = $2$": None, r"$d\$b$ = c": r"$$d\$b = c$$", "y = $$x$$": None,
        r"\text{softmax} = $x$": r"$$\text{softmax} = x$$", r"[Source 1] $=$": None, "ReLU = GELU($x$), $y$$z$": "$$\\text{ReLU} = \\text{GELU}(x), $y$$z$$$",
    }
    text = "\n".join(cases)
    assert one(spark, text, G.promote_equations).split("\n") == [k if v is None else v for k, v in cases.items()]
    assert one(spark, None, G.promote_equations) is None
