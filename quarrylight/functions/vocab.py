"""Fixed values.

Every constant below is data that has to agree with the behaviour being reproduced: word
lists, phrases, patterns, thresholds and lookup tables. Nothing here is logic.
"""

# BM25 constants and the token shape.
BM25_K1 = 1.5
BM25_B = 0.75
BM25_TF_CAP = 65535
BM25_TOKEN = r"[a-z0-9]+(?:'[a-z]+)?"

# Words the sparse index drops.
BM25_STOP = """
the a an is are was were be been being have has had do does did will would shall should may might
must can could and but or nor not no so if than that this these those it its to of in for on with at
by from as into about between through during before after above below up down out off over under
again further then once here there when where why how all each every both few more most other some
such only own same too very just also we our us they their them he she him her his
""".split()

# Words the title index ignores in a question.
TITLE_STOP = """
what how does did do is are was were the a an and or if to of in on at by it be as so up no we its not
but they can which about have has this that than into between over from with many more
""".split()

# Words ignored when a question is compared with passages.
OVERLAP_STOP = """
the a an is are was were what how which who when where why does did do in of to for on with by from at
and or not that this it its be been has have had their they them than used using about between
specific according original showed paper model results much many can would could should will more
most such also each other these those some all best way ways good better different method approach
technique work works thing things
""".split()

# Words ignored when a sentence is matched to a source for citing.
CITATION_STOP = """
the a an is are was were be been being have has had do does did will would could should may might
shall can to of in for on with at by from as into through during and but or nor not so yet both
either this that these those it its they them their we our you your which what who how when where
than more also such each
""".split()

# Words ignored by the unsupported-sentence detector.
DETECTOR_STOP = """
the a an is are was were be been being have has had do does did will would could should may might can
shall to of in for on with at by from as into through during before after above below between out off
over under again further then once that this these those it its and but or nor not so yet both each
few more most other some such no only own same than too very
""".split()

# Words that do not count as content words in the faithfulness score.
CONTENT_STOP = """
the a an is are was were be been being have has had do does did will would shall should may might must
can could to of in for on with at by from that this these those it its as or and but not no so if than
then their there they we our us which who what how when where why i you he she me him her them my your
his s t re ve ll d m
""".split()

# Suffixes stripped from words, tried in this order.
SUFFIXES = """
ation tion sion ment ness able ible ting ing ated ized ised ous ive ful less ity ies ally ly ers er ed
es al s
""".split()

# Phrases by which an answer refuses.
REFUSAL_PHRASES = [
    "i don't have information",
    "i don't have sufficient information",
    "not covered in",
    "not appear in the",
    "no information about",
    "not mentioned in",
    "don't have enough information",
    "sources do not contain",
    "sources don't contain",
    "premise appears incorrect",
    "premise may be incorrect",
    "cannot find information",
    "not in my knowledge base",
    "not specified in",
    "not detailed in",
    "not disclosed",
    "does not specify",
    "does not mention",
    "does not provide",
    "do not contain",
    "do not specify",
    "do not provide",
    "no specific information",
    "insufficient information",
    "not explicitly stated",
    "not explicitly mentioned",
]

# Substrings that mark a question as being on topic.
DOMAIN_TERMS = [
    "model", "neural", "network", "training", "learning", "inference", "embedding", "encoder", "decoder", "layer",
    "parameter", "weight", "gradient", "loss", "optimizer", "epoch", "batch", "fine-tun", "pretrain", "finetun",
    "fine_tun", "transformer", "attention", "convolution", "recurrent", "cnn", "rnn", "lstm", "gru", "mlp",
    "feedforward", "residual", "normalization", "softmax", "relu", "gelu", "dropout", "pooling", "language", "token",
    "vocab", "bert", "gpt", "llm", "nlp", "prompt", "instruct", "chat", "generation", "translation", "summariz",
    "sentiment", "ner", "parsing", "corpus", "image", "vision", "diffusion", "gan", "vae", "clip", "segmentation",
    "detection", "recognition", "pixel", "convolutional", "lora", "rlhf", "peft", "rag", "retrieval", "augment",
    "quantiz", "distill", "pruning", "scaling", "benchmark", "evaluation", "metric", "perplexity", "bleu", "rouge",
    "accuracy", "f1", "paper", "arxiv", "research", "study", "experiment", "dataset", "baseline", "state-of-the-art",
    "sota", "ablation", "llama", "mistral", "gemma", "falcon", "mixtral", "chinchilla", "t5", "roberta", "electra",
    "albert", "deberta", "xlnet", "stable diffusion", "dalle", "midjourney", "vit", "resnet", "yolo", "detr", "sam",
    "whisper", "wav2vec", "mamba", "starcoder", "codex", "humaneval", "swe-bench", "deepseek", "colbert", "dpr",
    "llava", "vall-e", "distilbert", "qlora", "dora", "gptq", "awq", "smoothquant", "flashattention",
    "flash attention", "speculative decod", "react", "chain-of-thought", "chain of thought", "rope", "rotary", "yarn",
    "dit", "graphrag", "self-rag", "crag", "phi-", "mmlu", "chatbot arena", "llama guard", "swe-agent", "openhands",
    "state space", "state-space", "adam", "sgd", "cosine", "warmup", "schedule", "cross-entropy", "contrastive",
    "triplet", "reinforcement", "reward", "policy", "agent", "multimodal", "multi-modal", "alignment", "grounding",
]

# Substrings of a question that asks for an opinion.
OPINION_PHRASES = [
    "do you think",
    "your opinion",
    "in your view",
    "which do you prefer",
    "which do you recommend",
    "what do you think",
    "do you believe",
]

# Whole messages that are small talk.
CASUAL_MESSAGES = [
    "hi", "hello", "hey", "yo", "sup", "howdy", "hola", "greetings", "good morning",
    "good afternoon", "good evening", "what's up", "how are you", "thanks", "thank you", "bye",
    "goodbye", "help",
]

# Substrings that point to foundational or to recent work.
FOUNDATIONAL_PHRASES = [
    "what is", "what are", "explain", "introduce", "definition of", "basics of", "fundamental",
    "how does", "how do", "original paper", "first proposed", "seminal work", "who invented",
    "who created", "history of",
]
RECENT_PHRASES = [
    "sota", "state of the art", "state-of-the-art", "latest", "recent", "2023", "2024", "2025",
    "current", "modern", "new", "advances in", "improvements", "compared to",
]

# Patterns of questions that need more than one hop.
MULTI_HOP_PATTERNS = [
    "compare", "difference", "versus", "vs", "contrast", "better", "worse", "advantage",
    "disadvantage", "how does .* differ", "what is the difference", "relationship between",
    "how does .* relate", "what led to", "evolution of", "trace the", "step by step",
    "explain how .* affects",
]

# Words of questions that span several documents.
MULTI_DOC_WORDS = [
    "compare", "contrast", "differ", "difference", "versus", "vs", "both", "each", "between",
    "evolution", "trace", "history", "combine", "together", "design a", "build a", "pipeline",
    "system", "impact", "think about", "philosophy", "approach to", "foundational", "fundamental",
]
ABSTRACT_WORDS = [
    "impact", "think about", "philosophy", "foundational", "design a", "build a", "create a",
    "system that", "how we think", "approaches to", "fundamental",
]
NEEDS_TWO_SOURCES_WORDS = [
    "compare", "contrast", "differ", "both", "versus", "vs", "evolution from", "trace",
]
SYNTHESIS_WORDS = [
    "compare", "contrast", "difference", "differ", "evolution", "trace", "design a", "combine",
    "synthesis", "across", "build a system", "pipeline", "approaches", "each",
]

# Capitalised sentence openers that are no entities, and hyphen suffixes.
SENTENCE_OPENERS = """
What Who How Why When Where Which The According Did Does Do Is Are Can Could Would Should Both Compare
Describe Explain Walk Tell List Summarize Outline Detail Give Name Define Discuss
""".split()
HYPHEN_SUFFIXES = "trained based like style type level free aware specific driven tuned".split()
VARIANT_SUFFIXES = "-trained -based -like -tuned -aware -specific -driven".split()
CONCEPT_ACRONYMS = """
rag llm llms nlp ml ai cv rl gan gans vae vaes rnn rnns cnn cnns dnn dnns ssl rlhf dpo sft ppo moe
""".split()

# Evidence words for a studied application, and its method words.
RESULT_WORDS = [
    "accuracy", "performance", "results", "experiments", "trained", "evaluated", "tested", "score",
    "benchmark", "dataset", "loss", "metric", "improve", "achieve", "outperform", "table", "figure",
    "shown in",
]
METHOD_WORDS = ["lora", "low-rank", "adaptation"]

# Words an answer-alignment focus may not be.
ALIGNMENT_SKIP = "is are was were does did do the a an of data information".split()

# Shape of citations, source blocks, claims.
SOURCES_BLOCK = r"\n\s*(?:\[Source[^\]]*\]:|Sources?:)"
CITE_NAMED = r"\[Source\s+(\d+)\]"
CITE_BARE = r"\[(\d{1,2})\]"
CITE_ANY = r"\[Source\s+\d+\]|\[\d{1,2}\]"
CLAIM_TERM = (
    r"(?i)\b(?:parameter|layer|architecture|training|dataset|performance|accuracy|score|benchmark|"
    r"attention|embedding|token|transformer|neural|matrix|vector|gradient|loss|weight|dimension|head|"
    r"softmax|linear|epoch|batch|precision|recall|f1|bleu|rouge|perplexity|latency|throughput)\b"
)
CLAIM_NUMBER = r"\b\d+(?:[.,]\d+)?(?:\s*(?:billion|million|thousand|%|ms|gb|tb))?\b"

# Sections that are not indexed, and the reading order of sections.
SECTION_BLOCKLIST = [
    "references", "bibliography", "acknowledgments", "acknowledgements", "acknowledgment",
    "acknowledgement", "preamble", "author_contributions", "funding", "competing_interests",
    "data_availability", "ethics_statement",
]
SECTION_ORDER = {
    "abstract": 0, "introduction": 1, "background": 2, "related_work": 3, "related work": 3,
    "method": 4, "methods": 4, "methodology": 4, "approach": 4, "model": 5, "architecture": 5,
    "experiments": 6, "results": 7, "evaluation": 7, "discussion": 8, "analysis": 8,
    "conclusion": 9, "conclusions": 9, "references": 10,
}
SECTION_ORDER_DEFAULT = 5
PREFERRED_SECTIONS = ["abstract", "introduction", "background", "model", "architecture", "method"]

# Chunk sizes, retrieval sizes, fusion weights.
CHUNK_CHARS = 1024
CHUNK_OVERLAP_CHARS = 128
MIN_SECTION_CHARS = 50
MIN_CHUNK_CHARS = 100
MIN_PAPER_CHARS = 100
CHUNK_SEPARATORS = ["\n\n", "\n", ". ", "; ", ", ", " ", ""]
TOP_K = 10
RELEVANCE_THRESHOLD = 0.3
FIRST_STAGE_K = 500
RERANK_POOL = 200
SPARSE_WEIGHT = 0.4
DENSE_WEIGHT = 0.6
RRF_K = 60
HASH_DIM = 768
QUERY_PREFIX = "Represent this sentence for searching relevant passages: "

# Telemetry buffer sizes and histogram bucket bounds.
RING_REQUESTS = 1000
RING_RECENT = 50
RING_SERIES = 500
BUCKETS = {
    "request": [0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0, 30.0, 60.0],
    "retrieval": [0.05, 0.1, 0.25, 0.5, 1.0, 2.0, 5.0],
    "generation": [0.5, 1.0, 2.5, 5.0, 10.0, 30.0, 60.0],
    "reranking": [0.05, 0.1, 0.25, 0.5, 1.0, 2.0],
    "top_score": [0.1, 0.2, 0.3, 0.5, 0.7, 1.0, 2.0, 3.0, 5.0, 8.0],
    "coverage": [0.0, 0.2, 0.4, 0.6, 0.8, 1.0],
}

# Landmark papers as (id, title, boost, year).
LANDMARK_PAPERS = [
    ("1706.03762", "Attention Is All You Need", 2.0, 2017),
    ("1810.04805", "BERT", 1.8, 2018),
    ("1910.10683", "T5", 1.6, 2019),
    ("2005.14165", "GPT-3", 1.6, 2020),
    ("2307.09288", "Llama 2", 1.4, 2023),
    ("2310.06825", "Mistral 7B", 1.4, 2023),
    ("2401.04088", "Mixtral", 1.4, 2024),
    ("2005.11401", "RAG", 1.5, 2020),
    ("2210.07316", "REPLUG", 1.3, 2022),
    ("2212.10496", "Self-RAG", 1.3, 2022),
    ("1512.03385", "ResNet", 1.5, 2015),
    ("1409.1556", "VGG", 1.4, 2014),
    ("2010.11929", "Vision Transformer", 1.4, 2020),
    ("1412.6980", "Adam", 1.5, 2014),
    ("1502.03167", "Batch Normalization", 1.4, 2015),
    ("1607.06450", "Layer Normalization", 1.3, 2016),
    ("2106.09685", "LoRA", 1.4, 2021),
    ("2110.04366", "Prefix Tuning", 1.3, 2021),
    ("1707.06347", "PPO", 1.5, 2017),
    ("2203.02155", "InstructGPT", 1.4, 2022),
    ("2002.08512", "BLEU Score", 1.3, 2002),
    ("1803.05449", "ROUGE", 1.3, 2004),
    ("2006.11239", "DDPM", 1.4, 2020),
    ("2112.10752", "Stable Diffusion", 1.4, 2022),
    ("2103.00020", "CLIP", 1.4, 2021),
    ("2001.08361", "Scaling Laws", 1.4, 2020),
    ("2203.15556", "Chinchilla", 1.4, 2022),
    ("2104.09864", "RoPE", 1.3, 2021),
    ("2101.03961", "Switch Transformer", 1.3, 2021),
    ("2201.11903", "Chain-of-Thought", 1.3, 2022),
]

# Topic substring -> landmark ids.
TOPIC_PAPERS = {
    "transformer": ["1706.03762"],
    "attention": ["1706.03762"],
    "self-attention": ["1706.03762"],
    "self attention": ["1706.03762"],
    "multi-head attention": ["1706.03762"],
    "bert": ["1810.04805"],
    "masked language model": ["1810.04805"],
    "t5": ["1910.10683"],
    "text-to-text": ["1910.10683"],
    "gpt-3": ["2005.14165"],
    "gpt3": ["2005.14165"],
    "in-context learning": ["2005.14165"],
    "llama": ["2307.09288"],
    "mistral": ["2310.06825"],
    "mixtral": ["2401.04088"],
    "mixture of experts": ["2401.04088"],
    "rag": ["2005.11401"],
    "retrieval augmented generation": ["2005.11401"],
    "retrieval-augmented": ["2005.11401"],
    "resnet": ["1512.03385"],
    "residual network": ["1512.03385"],
    "vgg": ["1409.1556"],
    "vision transformer": ["2010.11929"],
    "vit": ["2010.11929"],
    "adam optimizer": ["1412.6980"],
    "batch normalization": ["1502.03167"],
    "batch norm": ["1502.03167"],
    "layer normalization": ["1607.06450"],
    "layer norm": ["1607.06450"],
    "lora": ["2106.09685"],
    "low-rank adaptation": ["2106.09685"],
    "prefix tuning": ["2110.04366"],
    "ppo": ["1707.06347"],
    "proximal policy": ["1707.06347"],
    "instructgpt": ["2203.02155"],
    "rlhf": ["2203.02155", "1707.06347"],
    "diffusion": ["2006.11239"],
    "ddpm": ["2006.11239"],
    "denoising diffusion": ["2006.11239"],
    "stable diffusion": ["2112.10752"],
    "latent diffusion": ["2112.10752"],
    "clip": ["2103.00020"],
    "contrastive language": ["2103.00020"],
    "scaling law": ["2001.08361"],
    "scaling laws": ["2001.08361"],
    "chinchilla": ["2203.15556"],
    "compute-optimal": ["2203.15556"],
    "compute optimal": ["2203.15556"],
    "rope": ["2104.09864"],
    "rotary position": ["2104.09864"],
    "rotary embedding": ["2104.09864"],
    "switch transformer": ["2101.03961"],
    "chain-of-thought": ["2201.11903"],
    "chain of thought": ["2201.11903"],
}

# Entity and relation types offered to extractors.
ENTITY_TYPES = "MODEL DATASET METHOD METRIC TASK TOOL".split()
RELATION_TYPES = """
USES OUTPERFORMS EXTENDS TRAINED_ON EVALUATED_ON ACHIEVES PART_OF COMPARED_WITH VARIANT_OF PROPOSED_IN
""".split()

# Abbreviations that do not end a sentence.
ABBREVIATIONS = ["dr", "mr", "mrs", "ms", "prof", "jr", "sr", "vs", "etc", "approx", "i.e", "e.g"]

# Factors by age of a paper per kind of question (up to a year, or since a year); other years count 1, or the rest.
AGE_FACTORS = {
    "foundational": [(2017, 1.8), (2020, 1.5), (2022, 1.2)],
    "balanced": [(2018, 1.2), (2021, 1.1)],
}
RECENT_FACTORS = [(2023, 1.3), (2021, 1.1)]
RECENT_REST = 0.9

# Top scores and the share of the top score that keeps a source, with a dominant top and without.
SOURCE_RATIOS = {"logit": (2.0, 3.0, 0.7, 0.35), "sigmoid": (0.05, 0.7, 0.8, 0.5)}
DOMINANT_LEAD = 1.8
