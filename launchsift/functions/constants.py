"""Fixed values shared by the operators.

Everything in this file is a value whose exact text or number decides the result
(enumerations, thresholds, default texts, price lists); none of it is logic.
"""

from __future__ import annotations

# -- fixed values: enumerations, in their declared order ---------------------
AGENTS = ("hunter", "social", "chain", "risk", "narrator")
STREAMS = (
    "stream:candidates",
    "stream:social",
    "stream:chain",
    "stream:risk",
    "stream:briefs",
    "stream:human_review",
)
TIERS = ("degen", "speculative", "moderate", "high")
CONFIDENCES = ("low", "medium", "high")
QUALITIES = ("ok", "degraded")

# -- fixed values: identifier and address formats ----------------------------
CROCKFORD_ID = "^[0-9A-HJKMNP-TV-Z]{26}$"
HEX64 = "^[0-9a-f]{64}$"
ADDRESS = "^0x[0-9a-fA-F]{40}$"
ZERO_ADDRESS = "0x" + "0" * 40
# The characters removed from both ends of a text when it is stripped.
BLANKS = " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0"

# -- fixed values: launch feed and explorer texts ----------------------------
DEFAULT_SOURCE_URL = "https://four.meme"
TX_URL = "https://bscscan.com/tx/"
TOKEN_URL = "https://testnet.bscscan.com/token/"
EXPLORER_LABEL = "BscScan"
ONCHAIN_NAME = "(on-chain)"
UNKNOWN_SYMBOL = "?"
UNKNOWN_NAME = "unknown"

# -- fixed values: limits and thresholds -------------------------------------
CHANNEL_TAIL = 40
SEARCH_PAGE = 20
SAMPLE_COUNT = 5
SAMPLE_WIDTH = 280
HOLDER_PAGE = 100
HOLDER_TOP = 10
TRANSFER_PAGE = 100
CREATOR_PAGE = 100
CREATOR_TX_PER_TOKEN = 50
WHALE_THRESHOLD = 1000.0
DEFAULT_DECIMALS = 18
PAIR_TIMEOUT_S = 120
QUOTA_CAPACITY = 60
QUOTA_PERIOD_S = 60
CIRCUIT_FAILURES = 3
CIRCUIT_COOLDOWN_S = 60
DELIVERY_MEMORY_S = 7 * 24 * 3600
STREAM_KEEP = 100_000
BEAT_SECONDS = 10
LAUNCH_DEDUP_S = 24 * 3600
POSTING_HANDLES = 10
LATENCY_BOUNDS = (
    0.005, 0.01, 0.025, 0.05, 0.075, 0.1, 0.25, 0.5, 0.75, 1.0, 2.5, 5.0, 7.5, 10.0,
)

# -- fixed values: flags and default texts -----------------------------------
FLAG_SEARCH_BLOCKED = "x_scrape_blocked"
FLAG_CHANNEL_BLOCKED = "telegram_scrape_blocked"
FLAG_SCORER_EXHAUSTED = "social_llm_exhausted"
TEXT_NO_MODEL = "LLM providers unreachable. Verdict is heuristic-only and not narrative."
TEXT_NO_RATIONALE = "No rationale produced."
TEXT_REVIEW = "requires-human-review"
TEXT_THESIS_NO_MODEL = "LLM unavailable; heuristic-only brief."
TEXT_CAVEAT_NO_MODEL = "LLM providers unreachable — brief is heuristic-only."
TEXT_NO_THESIS = "No thesis available."
TEXT_UNKNOWN_TOKEN = "Unknown"

# -- fixed values: USD per 1,000 (input, output) tokens ----------------------
PRICES = {
    "anthropic/claude-opus-4-7": (15.00, 75.00),
    "anthropic/claude-sonnet-4-6": (3.00, 15.00),
    "anthropic/claude-haiku-4-5": (0.80, 4.00),
    "openai/gpt-4o": (2.50, 10.00),
    "openai/gpt-4o-mini": (0.15, 0.60),
    "google/gemini-2.5-pro": (1.25, 5.00),
    "google/gemini-2.5-flash": (0.075, 0.30),
}

# -- fixed values: ordered fallbacks by primary model ------------------------
FALLBACKS = {
    "google/gemini-2.5-flash": ["anthropic/claude-haiku-4-5", "openai/gpt-4o-mini"],
    "openai/gpt-4o": ["anthropic/claude-sonnet-4-6", "google/gemini-2.5-pro"],
    "anthropic/claude-sonnet-4-6": ["openai/gpt-4o", "google/gemini-2.5-pro"],
    "anthropic/claude-opus-4-7": ["openai/gpt-4o", "google/gemini-2.5-pro"],
}

# -- fixed values: USD per provider and day ----------------------------------
DAILY_CAPS = {"anthropic": 50.0, "openai": 50.0, "google": 20.0, "dgrid": 100.0}
