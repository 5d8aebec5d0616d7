"""Values that decide results.

Everything in this module is a fixed value of the scoring model: word lists,
patterns, weights, thresholds and formats. They are stated once, in the order
in which the rules consult them, and are used by the Column builders in
``trustlake.functions``.
"""

from __future__ import annotations

# --- fixed values: identifiers -------------------------------------------------
ID_MODULUS = 9999999967
ARTIFACT_TYPES = ("model", "dataset", "code")
PAGE_SIZE = 50
UNKNOWN_NAME = "Unknown Name"

# Characters that Python's str.strip() removes.
WHITESPACE = (
    " \t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
# Characters at which Python's str.splitlines() breaks a line.
LINE_BREAKS = "\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029"

# --- fixed values: metric registry ---------------------------------------------
# Weight of each metric in the net score; the order is the order of summation.
METRIC_WEIGHTS = {
    "ramp_up_time": 0.10,
    "bus_factor": 0.10,
    "performance_claims": 0.10,
    "license": 0.10,
    "size_score": 0.10,
    "dataset_and_code_score": 0.10,
    "dataset_quality": 0.10,
    "code_quality": 0.10,
    "reviewedness": 0.10,
    "reproducibility": 0.10,
}
ADMISSION_THRESHOLD = 0.5
TREE_SCORE = 0.75
DEVICES = ("raspberry_pi", "jetson_nano", "desktop_pc", "aws_server")
# (label, exclusive upper bound of the net score)
TRUST_BANDS = (("low", 0.3), ("moderate", 0.7), ("strong", None))

# --- fixed values: hub and code host ---------------------------------------------
HUB_HOST = "huggingface.co"
CODE_HOST = "github.com"
# Path segments that end the repository part of a hub URL.
NON_REPO_SEGMENTS = ("tree", "blob", "resolve", "commits", "discussions", "files")
REPO_LINK = r"github\.com/([A-Za-z0-9_.-]+)/([A-Za-z0-9_.-]+)"
# Files worth reading from a repository, and the branches tried for each.
REPO_FILES = (
    "README.md",
    "README.yaml",
    "model_index.json",
    "config.json",
    "LICENSE",
    "LICENSE.txt",
    "COPYING",
)
BRANCHES = ("main", "master")
# Files read for performance claims, best first.
CLAIM_FILES = (
    "README.md",
    "model_index.json",
    "README.yaml",
    "config.json",
    "model_card.json",
)

# --- fixed values: size score ----------------------------------------------------
WEIGHT_EXTENSIONS = (
    ".safetensors",
    ".bin",
    ".h5",
    ".hdf5",
    ".ckpt",
    ".pt",
    ".pth",
    ".onnx",
    ".gguf",
    ".msgpack",
)
WEIGHT_STEMS = (
    "pytorch_model",
    "model",
    "tf_model",
    "flax_model",
    "diffusion_pytorch_model",
    "adapter_model",
)
MIN_WEIGHT_BYTES = 5 * 1024 * 1024
WEIGHT_CAP_BYTES = 120 * 1024**3
GIB = 1024**3
# Device -> ladder of (GiB bound, score); the first bound above the size wins.
# The first rung of raspberry_pi also includes its bound.
DEVICE_LADDERS = {
    "raspberry_pi": ((0.2, 1.0), (0.5, 0.8), (2.0, 0.6), (4.0, 0.4), (8.0, 0.2)),
    "jetson_nano": ((0.5, 1.0), (1.0, 0.75), (4.0, 0.5), (8.0, 0.25)),
    "desktop_pc": ((4.0, 1.0), (8.0, 0.8), (16.0, 0.6), (32.0, 0.4), (64.0, 0.2)),
    "aws_server": ((40.0, 1.0), (60.0, 0.8), (80.0, 0.6), (100.0, 0.4), (120.0, 0.2)),
}

# --- fixed values: reviewedness --------------------------------------------------
RECENT_PRS = 30
BINARY_EXTENSIONS = (".bin", ".safetensors", ".ckpt", ".pt", ".pth", ".onnx")

# --- fixed values: code quality --------------------------------------------------
MAX_CODE_FILES = 7
NO_CODE_SCORE = 0.5
RISKY_CALLS = ("eval", "exec", "compile")

# --- fixed values: performance claims --------------------------------------------
METRIC_WORDS = (
    "accuracy", "acc", "f1", "f1-score", "precision", "recall", "auc", "auroc",
    "bleu", "rouge", "meteor", "ter", "chrf", "mse", "rmse", "mae", "r2", "perplexity",
    "wer", "cer", "map", "mrr", "ndcg", "exact match", "em", "top-1", "top-5",
    "glue", "squad", "librispeech", "common voice", "wmt", "imagenet", "superglue",
)
PLACEHOLDER_WORDS = (
    "more information needed", "tbd", "coming soon", "todo", "n/a", "none",
)
NUMBER = r"\b\d+(?:\.\d+)?\s*%?\b"
DATE_OR_VERSION = r"(\b20\d{2}\b|\b\d{4}-\d{2}-\d{2}\b|\bv?\d+(?:\.\d+){1,}\b)"
YAML_VALUE = r"\bvalue\s*:\s*[-+]?\d+(?:\.\d+)?"
CLAIM_HEADING = r"\b(evaluation|results?|benchmarks?|performance|metrics?)\b"
HEADING_SPLIT = r"\n(?=#{1,6}\s)"
METRIC_TABLE = r"\n\|.*\|\n\|[-:\s|]+\|\n(?:\|.*\|\n)+"
CLAIM_WINDOW = 100
DATE_WINDOW = 10
NO_FILES_SCORE = 0.1

# --- fixed values: dataset and code ----------------------------------------------
PYTHON_SIGNALS = (
    "```python",
    "from transformers import",
    "autotokenizer",
    "automodel",
    "pipeline(",
    "pip install transformers",
)

# --- fixed values: dataset quality -----------------------------------------------
TRUSTED_DATASETS = (
    "bookcorpus", "wikipedia", "openwebtext", "common crawl", "c4", "pile",
    "imagenet", "coco", "librispeech", "laion", "squad", "squad v2", "mnist",
    "cifar-10", "cifar10",
)
STRONG_DATASETS = ("bookcorpus", "wikipedia")
QUALITY_WORDS = (
    "dedup", "de-dup", "de-duplicate", "remove duplicates",
    "filter", "filtered", "quality filter",
    "balanced", "class balance", "stratified",
    "train/val", "train/valid", "train/test", "validation set", "evaluation set",
    "data cleaning", "preprocessing",
)
# Section headings that introduce the training data, tried in this order.
DATASET_HEADINGS = (
    r"dataset|datasets",
    r"training data|pre[- ]?training data|pre[- ]?trained on|data|corpus",
)
LICENSE_HEADING = r"licens(?:e|ing)"
LICENSE_LINE = r"^\s*license\s*:\s*([^\r\n#]+)$"

# --- fixed values: license -------------------------------------------------------
LICENSE_RESTRICTIVE = (
    r"\bagpl(?:-?3(?:\.0)?)?(?:-only|-or-later|\+)?\b",
    r"\bgpl(?:-?2(?:\.0)?|-?3(?:\.0)?)(?:-only|-or-later|\+)?\b",
    r"\bgplv2\b", r"\bgplv3\b",
    r"\bcc-?by-?nc\b", r"\bcc-?nc\b", r"\bnon[-\s]?commercial\b", r"\bnoncommercial\b",
    r"\bresearch[-\s]?only\b", r"\bresearch[-\s]?use\b",
    r"\bno[-\s]?derivatives?\b",
    r"\bproprietary\b", r"\bclosed[-\s]?source\b",
)
LICENSE_UNCLEAR = (
    r"\bllama[-\s]?2\b", r"\bmeta[-\s]?llama\b", r"\bllama[-\s]?2[-\s]?community[-\s]?license\b",
    r"\bgemma\b", r"\bgemma[-\s]?terms\b", r"\btii[-\s]?falcon[-\s]?license\b",
    r"\bqwen[-\s]?license\b",
    r"\bopenrail(?:-[ml])?\b", r"\bopen[-\s]?rail\b",
    r"\bcc[-\s]?by[-\s]?sa\b", r"\bshare[-\s]?alike\b",
    r"\blgpl[-\s]?3(?:\.0)?\b",
)
LICENSE_PERMISSIVE = (
    r"\bmit\b",
    r"\bapache(?:-|\s)?(?:license[-\s]?)?(?:version[-\s]?)?2(?:\.0)?\b", r"\bapache2\b",
    r"\bbsd\b", r"\bbsd-2-clause\b", r"\bbsd-3-clause\b",
    r"\bmpl(?:-|\s)?2(?:\.0)?\b", r"\bmozilla[-\s]?public[-\s]?license[-\s]?2(?:\.0)?\b",
    r"\blgpl(?:-?2\.1)(?:-only|-or-later|\+)?\b",
    r"\bcc[-\s]?by\b", r"\bcc[-\s]?by[-\s]?4\.0\b", r"\bcc0\b",
    r"\bcreative[-\s]?commons[-\s]?zero\b",
    r"\bunlicense\b",
)
LICENSE_COMPATIBLE = (
    r"\bmit\b",
    r"\bapache(?:-|\s)?(?:license[-\s]?)?(?:version[-\s]?)?2(?:\.0)?\b", r"\bapache2\b",
    r"\bbsd\b", r"\bbsd-2-clause\b", r"\bbsd-3-clause\b",
    r"\bcc0\b", r"\bcreative[-\s]?commons[-\s]?zero\b",
    r"\bcc[-\s]?by\b", r"\bcc[-\s]?by[-\s]?4\.0\b",
    r"\bunlicense\b",
    r"\blgpl(?:-?2\.1)(?:-only|-or-later|\+)?\b",
    r"\bmpl(?:-|\s)?2(?:\.0)?\b",
)

# --- fixed values: reproducibility -----------------------------------------------
STATUS_CODE = r"Final Response -- Status Code : (\d+(?:\.\d+)?)"
STATUS_CODE_LENIENT = r"Final Response -- Status Code\s*:\s*(\d+(?:\.\d+)?)"

# --- fixed values: search guard --------------------------------------------------
NESTED_QUANTIFIERS = (
    r"\([^\)]*\+\)\+",
    r"\([^\)]*\*\)\*",
    r"\([^\)]*\?\)\?",
    r"\([^\)]*\+\)\*",
    r"\([^\)]*\*\)\+",
    r"\([^\)]*\+\)\?",
    r"\([^\)]*\*\)\?",
    r"\(\.\+\)\+",
    r"\(\.\*\)\+",
    r"\(\.\+\)\*",
    r"\)([\+\*\?])\s*([\+\*\?])",
)
MAX_REPEAT = 500
REASON_NESTED = "Nested quantifiers detected"
REASON_REPEAT = "Repeat range too large"
REASON_AMBIGUOUS = "Ambiguous alternation inside repetition"

# --- fixed values: health --------------------------------------------------------
PERIOD = "5 minutes"
LOOK_BACK_HOURS = 1
RECENT_ERRORS = 20
LOG_RESULT_CAP = 500
ERROR_LINE = "(?i)error"
WARNING_LINE = "(?i)warn"
