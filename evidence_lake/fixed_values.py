"""Values that results depend on and that therefore may not be changed.

Everything here is a fixed value: limits, thresholds, word lists, patterns and
prompt wording.  Logic lives elsewhere.
"""

# --- fixed values: text ------------------------------------------------------
# Characters that count as whitespace when stripping and collapsing.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
WHITESPACE_CLASS = r"\t-\r\x1c-\x1f \x85\p{Z}"
WORD_PATTERN = r"[\p{L}\p{N}_]+"

# --- fixed values: bibliographic records --------------------------------------
MIN_YEAR, MAX_YEAR = 1000, 2100
DOI_PATTERN = r"^10\.\p{Nd}{4,9}/[^" + WHITESPACE_CLASS + r"]+$"
DOI_PREFIX_PATTERN = r"(?i)^(https://doi\.org/|http://doi\.org/|doi:)"
DOI_URL_PREFIX = "https://doi.org/"
PROVIDER_PREFERENCE = ("openalex", "crossref")
DEFAULT_PROVIDER = "openalex"
UNTITLED = "(sem título)"

# --- fixed values: files --------------------------------------------------------
MAX_FILE_BYTES = 50 * 1024 * 1024
FETCH_CONTENT_TYPES = ("application/pdf", "text/html", "application/octet-stream")
STORE_CONTENT_TYPES = ("application/pdf",)

# --- fixed values: structure and chunks ------------------------------------------
HEADING_FONT_RATIO = 1.15
HEADING_MAX_CHARS = 120
TABLE_GAP_PATTERN = " {3,}"
LINE_Y_TOLERANCE = 1.0
CHUNK_SIZE = 1000
CHUNK_SEPARATOR = "\n\n"
CHUNK_STRATEGY = "structure_aware"
CHUNK_NAMESPACE = "6f2f6e0a-9d3f-4b8a-9c0a-9a2e5b7d5a1e"

# --- fixed values: embedding and retrieval ----------------------------------------
EMBEDDING_BATCH = 100
TOP_K = 5
MIN_SCORE = 0.7

# --- fixed values: evidence and confidence ------------------------------------------
MIN_TOKEN_OVERLAP = 0.6
EVIDENCE_STATUSES = ("unsupported", "inconclusive", "supported")  # weakest first
VALIDATION_STATUSES = ("supported", "partially_supported", "unsupported")
BASE_SCORES = {"supported": 0.6, "inconclusive": 0.5, "unsupported": 0.0}
HIGH_SIMILARITY, MEDIUM_SIMILARITY = 0.85, 0.70
HIGH_SIMILARITY_BONUS, MEDIUM_SIMILARITY_BONUS = 0.2, 0.1
COVERAGE_MIN, COVERAGE_BONUS = 2, 0.1
HIGH_LEVEL, MEDIUM_LEVEL = 0.75, 0.45
# values of ``error`` columns
VECTOR_COUNT_ERROR = "Provider returned {got} vectors for {wanted} chunks"
NO_OUTPUT_ERROR = "Model returned no parsed structured output"
NO_EVIDENCE_REASON = "No evidence text available; the claim cannot be validated as supported."
LOW_REASON = (
    "LOW confidence: this claim is not confirmed by the available "
    "evidence and must not be treated as a verified fact."
)
PROVENANCE_LEVELS = ("claim", "evidence", "chunk", "page", "document", "source")

# --- fixed values: tables ---------------------------------------------------------
LIST_LIMIT, LIST_MAX = 50, 200
DOCUMENT_STATUSES = ("pending", "downloaded", "processed", "failed")
RESEARCH_STATUSES = ("DRAFT", "READY")
RESEARCH_MAX_CHARS = {"title": 200, "objective": 5000, "question": 2000}
RESEARCH_FORM_MESSAGES = {
    "title": ("Título é obrigatório.", "Título deve ter no máximo 200 caracteres."),
    "objective": ("Objetivo é obrigatório.", "Objetivo deve ter no máximo 5000 caracteres."),
    "question": ("Pergunta é obrigatória.", "Pergunta deve ter no máximo 2000 caracteres."),
}
DOCUMENT_MAX_CHARS = {"source": 50, "external_id": 500, "title": 1000, "doi": 255, "url": 2000}

# --- fixed values: prompt wording -----------------------------------------------------
CLAIM_PROMPT = """\
You are a research assistant extracting verifiable factual claims.
Given the user's question and a set of source chunks, list every
factual, verifiable claim that is directly supported by the chunks.

Rules:
- Return only claims that are explicitly supported by the chunks.
- For every claim, include the chunk_ids that support it.
- Do not invent claims; if a chunk supports no claim, skip it.
- Respond with a JSON object matching the requested schema: a
  'claims' list where each item has 'text' and 'chunk_ids'.

User question: {question}

Source chunks:
{chunks}"""

EVIDENCE_PROMPT = """\
You are a research assistant verifying whether a claim is supported
by the provided source chunks.

Claim:
{claim}

For the claim above, examine the source chunks and produce evidence.
Rules:
- 'text' must be the exact, verbatim passage from a chunk that
  supports or informs the claim. Never invent or rewrite text.
- 'chunk_id' is the id of the chunk the passage comes from.
- 'status' is:
    'supported' when a passage directly supports the claim;
    'inconclusive' when chunks relate only partially/ambiguously;
    'unsupported' when no chunk supports the claim.
- For 'unsupported', set 'text' and 'chunk_id' to null.

Source chunks:
{chunks}"""

VALIDATION_PROMPT = """\
You are validating whether a piece of evidence supports a claim.

Given this claim: "{claim}"
And this evidence from the document: "{evidence}"

Does the evidence support the claim?
Answer with one of: supported, partially_supported, unsupported.
Provide a brief reasoning."""

# fixed values: HTML elements that begin or end a block of text, elements that are not shown,
# and the character references that are decoded by name
HTML_BLOCKS = (
    "address", "article", "aside", "blockquote", "body", "dd", "details", "div", "dl", "dt", "fieldset",
    "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "head", "header", "hr", "html",
    "li", "main", "nav", "ol", "p", "pre", "section", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul",
)
HTML_HIDDEN = ("script", "style", "template", "title")
HTML_INLINE = (
    "a", "abbr", "b", "bdi", "bdo", "cite", "code", "em", "i", "kbd", "mark", "q", "s", "small", "span", "strong",
    "sub", "sup", "u",
)
HTML_ENTITIES = {
    "apos": "'", "bull": "\u2022", "cent": "\u00a2", "copy": "\u00a9", "deg": "\u00b0", "euro": "\u20ac",
    "gt": ">", "hellip": "\u2026", "laquo": "\u00ab", "ldquo": "\u201c", "lsquo": "\u2018", "lt": "<",
    "mdash": "\u2014", "middot": "\u00b7", "nbsp": "\u00a0", "ndash": "\u2013", "para": "\u00b6", "pound": "\u00a3",
    "quot": '"', "raquo": "\u00bb", "rdquo": "\u201d", "reg": "\u00ae", "rsquo": "\u2019", "sect": "\u00a7",
    "times": "\u00d7", "trade": "\u2122", "yen": "\u00a5",
    "amp": "&",  # last, so that what it brings forth is not decoded again
}
