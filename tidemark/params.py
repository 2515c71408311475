"""Defaults of the engine. Everything here is a default argument somewhere; nothing is a hidden global."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date

# ---------------------------------------------------------------------------
# FIXED VALUES: data that results depend on, kept as plain text in natural order
# ---------------------------------------------------------------------------

# Anchor events of the four cycles
ANCHORS = (date(2012, 11, 28), date(2016, 7, 9), date(2020, 5, 11), date(2024, 4, 19))
PROJECTED_ANCHOR = date(2028, 3, 15)
DAYS_BEFORE, DAYS_AFTER = 550, 880

# History and trend limits
HISTORY_FLOOR = date(2010, 1, 1)
MIN_HISTORY_DATE = date(2024, 1, 10)
TREND_START, TREND_MIN_POINTS = date(2023, 11, 1), 30

# Sizes
UNIVERSE_SIZE, INDEX_TOP_N, SUMMARY_TOP_N, VOLUME_WINDOW, MIN_MEMBERS = 1000, 50, 10, 60, 3

# Quotes
QUOTES, DEFAULT_QUOTE, RANKING_QUOTE = ("BTC", "USD"), "BTC", "USD"

# Page that describes one entity, by upper-case symbol
ENTITY_PAGE = "https://www.cryptocompare.com/coins"

# Entities that are never filtered out
ALLOWED = "sui sei stk sand wif xlm stx storm snt storj strax stpt strk wild wifi".split()

# Fiat-pegged entities, by id
STABLE_IDS = """
usdt usdc dai usds usde susds pyusd susde usd1 usdf usdtb bfusd rlusd usdg usyc fdusd usdy usd0 usdd
tusd gho usdb frax lusd crvusd gusd busd usdp susd nusd eurs eurt eurc ageur mim dola
""".split()

# Fiat-pegged entities, by symbol (a smaller set than the ids)
STABLE_SYMBOLS = """
usdt usdc dai usds usde pyusd tusd busd gusd usdp lusd frax mim gho fdusd usdd susd eurs eurt usdy usdg
""".split()

# Wrapped, staked and bridged entities, by id
WRAPPED_IDS = """
wbtc tbtc hbtc renbtc sbtc fbtc lbtc solvbtc clbtc cbbtc enzobtc
steth wsteth weth wbeth weeth reth cbeth sfrxeth meth lseth rseth ezeth oseth ethx eeth sweth
aethweth aethusdc aethusdt aethdai aweth ausdc ausdt adai
wsol jitosol msol bnsol wbnb
""".split()

# Patterns searched in "id name"
WRAPPED_PATTERNS = (
    r"^wrapped-",
    r"^w[a-z]{2,6}$",
    r"-wrapped$",
    r"-wrapped-",
    r"^staked-",
    r"^st[a-z]{2,6}$",
    r"-staked$",
    r"-staked-",
    r"liquid.?staking",
    r"^bridged-",
    r"-bridged$",
    r"-bridged-",
    r"bridge[d]?$",
    r"restaked",
    r"^rs[a-z]{2,6}$",
    r"lido",
    r"rocket.?pool",
    r"coinbase.?wrapped",
    r"marinade",
    r"jito.?staked",
    r"ether\.?fi",
    r"swell",
    r"kelp.?dao",
    r"renzo",
    r"stader",
    r"stakewise",
    r"lombard",
    r"solv.?btc",
    r"threshold.?btc",
    r"^aave.*weth",
    r"^aave.*eth",
    r"^aeth",
)

# Base asset and its derivatives
BASE_IDS = ("btc",)
BASE_PATTERN = "btc|bitcoin"
DERIVATIVE_PATTERN = "wrapped|staked|bridged|liquid|synthetic|pegged|collateral|vault|yield"
DERIVATIVE_SYMBOLS = "wbtc tbtc hbtc renbtc sbtc fbtc lbtc solvbtc clbtc cbbtc enzobtc".split()

# Reasons written to reports
REASON_BASE = "Bitcoin (base currency)"
REASON_STABLE = "Stablecoin"
REASON_WRAPPED = "Wrapped/Staked/Bridged token"
REASON_DERIVATIVE = "BTC derivative"
REASON_SHORT_HISTORY = "Insufficient historical data (starts {})"
REASON_NO_PRICES = "No price data available"

# Header of the skipped-entity file
SKIPPED_HEADER = ("Coin ID", "Name", "Symbol", "Reason", "URL")

# ---------------------------------------------------------------------------


@dataclass(frozen=True)
class RuleSet:
    """Classification rules as data; pass another instance to classify another universe."""

    allowed: tuple[str, ...] = tuple(ALLOWED)
    stable_ids: tuple[str, ...] = tuple(STABLE_IDS)
    stable_symbols: tuple[str, ...] = tuple(STABLE_SYMBOLS)
    wrapped_ids: tuple[str, ...] = tuple(WRAPPED_IDS)
    wrapped_patterns: tuple[str, ...] = WRAPPED_PATTERNS
    base_ids: tuple[str, ...] = BASE_IDS
    base_pattern: str = BASE_PATTERN
    derivative_pattern: str = DERIVATIVE_PATTERN
    derivative_symbols: tuple[str, ...] = tuple(DERIVATIVE_SYMBOLS)
    base_reason: str = REASON_BASE
    stable_reason: str = REASON_STABLE
    wrapped_reason: str = REASON_WRAPPED
    derivative_reason: str = REASON_DERIVATIVE


DEFAULT_RULES = RuleSet()
