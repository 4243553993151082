"""Word lists and patterns that results depend on."""

# The sections in their order.
SECTIONS = ["Preamble", "Abstract", "Introduction", "Methodology", "Results", "Discussion", "Limitations", "Future Work", "References"]

# The order in which sections are read for summaries and contexts.
PRIORITY = ["Abstract", "Results", "Methodology", "Introduction", "Discussion", "Limitations", "Future Work", "Preamble", "References"]

# Headings that name a section.
ALIASES = {
    "Abstract": ["abstract", "executive summary", "summary"],
    "Introduction": ["introduction", "background", "motivation", "related work", "related works", "literature review"],
    "Methodology": ["methodology", "method", "methods", "materials and methods", "approach", "proposed approach", "model", "model architecture", "architecture", "system", "framework", "implementation", "experimental setup", "experiment setup"],
    "Results": ["results", "result", "experiments", "experiment", "experimental results", "experimental evaluation", "evaluation", "findings", "benchmarks", "benchmark results", "performance", "performance evaluation"],
    "Discussion": ["discussion", "analysis", "conclusion", "conclusions", "concluding remarks", "interpretation", "remarks"],
    "Limitations": ["limitations", "limitation", "threats to validity", "weaknesses", "constraints"],
    "Future Work": ["future work", "future works", "future directions", "future research", "outlook", "next steps", "conclusion and future work", "conclusions and future work"],
    "References": ["references", "bibliography", "works cited"],
}

# What may stand around a heading, headings that begin a line of text, sentence ends,
# tokens, and spans of mathematics.
HEADING_PREFIX, HEADING_END = r"(?:\d+(?:\.\d+)*\.?|[ivxlcdm]+\.?|[a-z]\.?)?\s*", r"\s*[:\-–—.]?"
RUN_ON = r"(abstract|introduction|methodology|methods?|results?|discussion|conclusions?|limitations?|future work|references)\b[:.\-–—]?\s+(.{40,})"
SENTENCE_END, SENTENCE_START = r"[.!?]", r"[A-Z0-9$(]"
TOKEN = r"[a-z0-9]+(?:'[a-z]+)?"
MATH_SPAN = r"\$\$.+?\$\$|\$.+?\$|\\\[.+?\\\]|\\\(.+?\\\)"

# Dates, stamps and identifiers of a paper.
ARXIV, YEAR, DOI = r"arXiv:\s*(\d{4})\.\d{4,5}", r"\b((?:19|20)\d{2})\b", r"\b(10\.\d{4,9}/[^\s\"'<>]+)"

# Numbers, pairs of scores, and the task of a result.
NUMBER, SCORES, TASK = r"-?\d+(?:\.\d+)?", r"from\s+(-?\d+(?:\.\d+)?)\s+to\s+(-?\d+(?:\.\d+)?)", r"\bon\s+([A-Z][\w\-]*(?:\s+[a-z\d]+)?)"

# Mathematical symbols and their LaTeX commands.
MATH = {
    "λ": r"\lambda", "β": r"\beta", "α": r"\alpha", "γ": r"\gamma", "δ": r"\delta", "ε": r"\epsilon", "θ": r"\theta", "μ": r"\mu", "σ": r"\sigma",
    "Σ": r"\Sigma", "π": r"\pi", "φ": r"\phi", "ψ": r"\psi", "ω": r"\omega", "Δ": r"\Delta", "∞": r"\infty", "×": r"\times", "·": r"\cdot", "÷": r"\div",
    "±": r"\pm", "≤": r"\leq", "≥": r"\geq", "≠": r"\neq", "≈": r"\approx", "∈": r"\in", "∉": r"\notin", "∑": r"\sum", "∏": r"\prod", "∫": r"\int",
    "∂": r"\partial", "√": r"\sqrt", "→": r"\rightarrow", "←": r"\leftarrow", "⇒": r"\Rightarrow",
}

# Hyperparameters and the patterns that find them, in order.
HYPERPARAMETERS = {
    "learning_rate": r"(?i)(?:learning rate|lr)\s*(?:of|=|:)?\s*([0-9.eE\-+]+)",
    "layers": r"(?i)(\d+)\s*[- ]layer",
    "optimizer": r"\b(AdamW?|SGD|RMSprop|Adagrad|Lion)\b",
    "batch_size": r"(?i)batch size\s*(?:of|=|:)?\s*(\d+)",
    "epochs": r"(?i)(\d+)\s*epochs?",
    "dropout": r"(?i)dropout\s*(?:of|=|:|rate)?\s*([0-9.]+)",
    "hidden_size": r"(?i)hidden (?:size|dim(?:ension)?)\s*(?:of|=|:)?\s*(\d+)",
    "heads": r"(?i)(\d+)\s*(?:attention )?heads?",
}

# Datasets known by the shape of their name, and by name.
DATASET_SHAPE = r"\b([A-Z][\w\-]*\d+)\s+(?:dataset|corpus|benchmark)\b"
DATASETS = ["WMT14", "WMT", "QM9", "ImageNet", "GLUE", "SQuAD", "CIFAR-10", "CIFAR", "COCO", "LibriSpeech", "WMT-14"]

# What is said of a paper where it says nothing.
NO_TEXT = ["No abstract extracted.", "No results extracted.", "No limitations extracted."]

# Hardware mentions.
HARDWARE = r"(?i)(\d+\s*x\s*(?:NVIDIA\s*)?(?:V100|A100|H100|A6000|RTX\s*\d+|GTX\s*\d+|GPU|TPU)s?|(?:V100|A100|H100|TPU v?\d+)(?:\s*x\s*\d+)?|\d+\s*GPU-hours?|\d+\s*(?:GPU|TPU)\s*days?)"

# Patterns of the three gap categories, in order of preference.
GAPS = {
    "failure_modes": [r"fail", r"error", r"poor", r"weak", r"degrad", r"\bdrop", r"struggl", r"untest", r"unexplor", r"\bonly\b.{0,20}(evaluat|test|english|small)", r"limit", r"brittle", r"instab", r"long\b.{0,15}(document|context|sequence)", r"hallucinat", r"bias"],
    "dataset_shortfalls": [r"dataset", r"\bdata\b", r"benchmark", r"evaluat", r"language", r"domain", r"generali", r"distribution", r"out-of", r"corpus", r"multilingual", r"low-resource", r"test set", r"real-world", r"modality", r"modalities"],
    "methodological_blinds": [r"ablat", r"hyperparameter", r"tuning", r"comparison", r"baseline", r"assum", r"blind", r"sensitiv", r"architectur.{0,10}choice", r"\bscale\b", r"comput", r"\bgpu", r"resource", r"carbon", r"theor", r"interpret"],
}

# Themes looked for in gap statements.
THEMES = ["multilingual", "long", "ablation", "generali", "scale", "robust", "real-world", "low-resource", "interpret", "efficiency", "hallucinat"]

# Metric words, those where less is better, and words of an architecture.
METRICS = ["BLEU", "ROUGE", "METEOR", "F1", "accuracy", "precision", "recall", "AUC", "MAE", "MSE", "RMSE", "perplexity", "PPL", "WER", "CER", "mAP", "IoU", "reward"]
LOWER_IS_BETTER = ["mae", "mse", "rmse", "perplexity", "ppl", "wer", "cer", "loss"]
ARCHITECTURE = ["transformer", "attention", "cnn", "convolutional", "gnn", "graph", "resnet", "bert", "gpt", "lstm", "gru", "diffusion", "vae", "gan", "mlp", "encoder", "decoder", "layer", "network", "architecture", "model"]
