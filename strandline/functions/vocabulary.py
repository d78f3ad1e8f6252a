"""Fixed values of caption semantics: patterns, cues and word lists, as they must be for equal results."""

#: tag: (patterns, primitives)
RULES: dict[str, tuple[list[str], list[str]]] = {
    "trend_up": ([r"\bupward trend\b", r"\bupward drift\b", r"\brise\b", r"\brises\b", r"\bincrease\b", r"\bincreases\b", r"\bclimb\b", r"\bclimbs\b"], ["add_trend", "add_ramp", "add_change_point"]),
    "trend_down": ([r"\bdownward trend\b", r"\bdownward drift\b", r"\bdeclin(?:e|es|ing)\b", r"\bfall\b", r"\bfalls\b", r"\bdrop\b", r"\bdrops\b", r"\bdecreas(?:e|es|ing)\b"], ["add_trend", "add_ramp", "add_change_point"]),
    "growth_curve": ([r"\bexponential growth\b", r"\baccelerating\b", r"\bsurges upward\b", r"\bcurved increase\b"], ["add_growth"]),
    "decay_curve": ([r"\bexponential decay\b", r"\baccelerating decline\b", r"\bcurved drop\b"], ["add_decay"]),
    "flat": ([r"\bflat\b", r"\bconstant\b", r"\bstable\b", r"\bplateau\b", r"\bhorizontal\b", r"\bstationary\b", r"\bhovers?\b"], ["add_flat"]),
    "seasonality": ([r"\bseasonal(?:ity)?\b", r"\bperiodic(?:ity)?\b", r"\bcyclic(?:al)?\b", r"\brepeating pattern\b"], ["add_seasonality"]),
    "peak": ([r"\bpeak\b", r"\blocal peak\b", r"\blocal maximum\b", r"\bhighest value\b"], ["add_peak"]),
    "trough": ([r"\btrough\b", r"\blocal trough\b", r"\blocal minimum\b", r"\blowest value\b"], ["add_trough"]),
    "spike": ([r"\bspike\b", r"\bsharp rise\b", r"\bsudden jump\b", r"\bbrief surge\b", r"\bimpulse\b", r"\bone-timestep\b", r"\bone timestep\b"], ["add_spike"]),
    "dip": ([r"\bdip\b", r"\bsharp drop\b", r"\bsudden fall\b", r"\bbrief drop\b"], ["add_dip"]),
    "outlier": ([r"\boutlier\b", r"\banomal(?:y|ous)\b", r"\bsingle-point\b", r"\bone unusual value\b"], ["add_outlier"]),
    "level_shift": ([r"\blevel shift\b", r"\bstep change\b", r"\bdownward shift\b", r"\bupward shift\b", r"\bshifts downward\b", r"\bshifts upward\b", r"\bmoves to a new sustained level\b", r"\bnew level\b"], ["add_level_shift"]),
    "change_point": ([r"\bchange point\b", r"\bregime change\b", r"\bturning point\b", r"\bbreak in trend\b"], ["add_change_point"]),
    "gap": ([r"\bgap\b", r"\bmissing interval\b", r"\bmissing values\b", r"\bdata absent\b", r"\bmissing entirely\b"], ["add_gap"]),
    "noise": ([r"\bnoise\b", r"\bnoisy\b", r"\brandom fluctuations\b", r"\bjitter\b"], ["add_noise"]),
    "volatility": ([r"\bvolatility\b", r"\bvolatile\b", r"\bfluctuat(?:e|es|ing|ions)\b", r"\berratic\b", r"\bswings\b", r"\boscillat(?:e|es|ing|ion)\b"], ["add_volatility"]),
    "volatility_change": ([r"\bmore volatile\b", r"\bless volatile\b", r"\bvolatility increases\b", r"\bvolatility decreases\b", r"\bincreased volatility\b", r"\bdecreased volatility\b"], ["add_volatility"]),
    "soft_level_reference": ([r"\bresistance\b.{0,40}\b(?:around|near|at|about)\b", r"\bsupport\b.{0,40}\b(?:around|near|at|about)\b", r"\bhover(?:s|ing)?\b.{0,40}\b(?:around|near|at|about)\b", r"\bstabili[sz](?:es|ing|ed)?\b.{0,40}\b(?:around|near|at|about)\b", r"\brange[- ]?bound\b.{0,40}\b(?:around|near|at|about)\b"], ["add_volatility", "add_flat"]),
    "mean_reversion": ([r"\bmean reversion\b", r"\bmean-reverting\b", r"\bmean reverting\b", r"\breturns? to (?:the )?mean\b"], []),
}
NEGATED_PHRASES: dict[str, list[str]] = {
    "peak": ["no peak", "no peaks", "no significant peaks", "no prominent peaks", "no local extrema", "no peaks or troughs"],
    "trough": ["no trough", "no troughs", "no significant troughs", "no prominent troughs", "no local extrema", "no peaks or troughs"],
    "mean_reversion": ["no evidence of mean reversion", "no mean reversion"],
}
NEGATIONS = ["no", "not", "without", "lack", "lacks", "lacking", "absence", "doesn't", "doesnt", "nor", "neither", "never"]
NEGATION_PAIRS = ["does not", "did not", "is not", "are not", "was not", "were not", "absence of"]
CALM = ["no volatility", "zero volatility", "virtually zero", "essentially zero", "nonexistent volatility", "perfectly stable", "perfectly flat", "completely flat", "constant signal", "remains constant", "value remains constant", "flat line", "unchanging", "invariant", "no fluctuations", "lack of variation"]
ORCHESTRATED = ["mean_reversion", "soft_level_reference"]

#: name: (category, core tags, caption cues), in catalog order
CATALOG: dict[str, tuple[str, list[str], list[str]]] = {
    "add_trend": ("trend", ["trend", "linear", "interval", "upward", "downward"], ["upward trend", "downward trend", "gradual increase", "gradual decline", "drift", "steady rise", "steady fall"]),
    "add_ramp": ("trend", ["trend", "linear", "ramp", "interval", "exact_value"], ["ramps up", "ramps down", "linearly rises to", "linearly falls to", "moves from X to Y", "piecewise linear segment"]),
    "add_flat": ("trend", ["flat", "constant", "level", "interval"], ["flat", "constant", "stable at", "remains at", "fixed value", "horizontal segment"]),
    "add_growth": ("trend", ["growth", "curve", "accelerating", "interval", "exact_value"], ["accelerating growth", "curved increase", "exponential growth", "surges upward", "increases faster over time"]),
    "add_decay": ("trend", ["decay", "curve", "accelerating", "interval", "exact_value"], ["accelerating decline", "curved drop", "exponential decay", "falls faster over time", "decays toward"]),
    "add_change_point": ("structural", ["change_point", "structural_change", "level_shift", "slope_shift", "transition"], ["change point", "regime change", "after timestep", "turning point", "slope changes", "break in trend"]),
    "add_seasonality": ("seasonal", ["seasonality", "periodic", "cycle", "waveform", "oscillation"], ["seasonal", "periodic", "cyclical", "repeating pattern", "wave-like", "oscillation with period"]),
    "add_peak": ("local_event", ["peak", "local_maximum", "bump", "positive_event"], ["peak", "local maximum", "rounded bump", "hump", "crests at"]),
    "add_trough": ("local_event", ["trough", "local_minimum", "valley", "negative_event"], ["trough", "local minimum", "valley", "rounded dip", "bottoms out"]),
    "add_spike": ("local_event", ["spike", "sharp_event", "positive_event", "local_jump"], ["spike", "sharp rise", "sudden jump", "brief surge", "isolated positive event"]),
    "add_dip": ("local_event", ["dip", "sharp_event", "negative_event", "local_drop"], ["dip", "sharp drop", "brief drop", "sudden fall", "isolated negative event"]),
    "add_outlier": ("local_event", ["outlier", "point_anomaly", "single_point", "anomaly"], ["outlier", "anomaly", "single-point jump", "isolated point", "one unusual value"]),
    "add_level_shift": ("structural", ["level_shift", "step_change", "regime_shift", "transition"], ["level shift", "step change", "moves to a new level", "downward shift", "upward shift", "step-like increase"]),
    "add_gap": ("structural", ["gap", "missing", "missing_interval", "mask"], ["gap", "missing interval", "missing values", "data absent", "masked segment"]),
    "add_noise": ("stochastic", ["noise", "stochastic", "volatility", "randomness"], ["noisy", "random fluctuations", "jitter", "volatility", "erratic small movements"]),
    "add_volatility": ("stochastic", ["volatility", "variance", "amplitude_scaling", "dispersion"], ["more volatile", "less volatile", "volatility increases", "volatility decreases", "larger swings", "smaller swings"]),
}

#: Phrase routing in order: (all of these groups must have a phrase in the text, add, remove, weak reason)
ROUTES: list[tuple[list[list[str]], list[str], list[str], str | None]] = [
    ([["linearly from"]], ["add_ramp", "add_trend"], [], None),
    ([["sharp spike", "sharp upward impulse", "one-timestep", "one timestep"]], ["add_spike"], [], None),
    ([["missing entirely"]], ["add_gap"], [], None),
    ([["shift", "jumps up by", "jumps down by"], ["new level", "lower level", "higher level", "jumps up by", "jumps down by"]], ["add_level_shift"], [], None),
    ([["regime shift"], ["new level", "lower level", "higher level", "jumps up by", "jumps down by"]], ["add_change_point"], [], None),
    ([["noise", "noisy", "random jitter", "jitter", "random fluctuations", "fresh random noise", "fresh random"]], ["add_noise"], [], None),
    ([["more volatile", "less volatile", "fluctuations become", "swings widen", "swings become", "same baseline", "rescaled", "being rescaled"]], ["add_volatility"], [], None),
    ([["resistance", "support", "range-bound", "range bound"]], ["add_volatility", "add_flat"], [], "soft_level_wording"),
    ([["rather than introducing fresh random noise", "rather than fresh random noise"]], [], ["add_noise"], None),
    ([["no claim"], ["rescaled"]], [], ["add_volatility"], None),
    ([["regime shift", "rather than just a finite plateau"]], ["add_level_shift", "add_change_point"], ["add_flat"], None),
    ([CALM], [], ["add_noise", "add_volatility"], None),
    ([["does not indicate any repeating period", "without explicit periodicity"]], ["add_noise", "add_volatility"], [], "oscillation_without_period"),
]
PERIODIC = ["seasonal", "periodic", "cyclic"]

# Ranking
EVENT_TERMS = ["peak", "trough", "dip", "spike", "outlier"]
TEXTURE_TERMS = ["noise", "fluctuation", "fluctuations", "volatile", "volatility", "oscillation", "oscillatory", "seasonal", "repeating"]
STRUCTURAL_TERMS = ["change", "shift", "transition", "regime", "break", "plateau", "flattening", "levels off"]
TREND_TERMS = ["trend", "decline", "decrease", "increase", "climb", "rise", "fall", "plateau", "flat", "stable"]
OVERWRITE_TERMS = ["stable", "flat", "constant", "level", "plateau"]
ADDITIVE_TERMS = ["peak", "dip", "spike", "fluctuation", "noise", "shift", "trend"]
SEASONAL_TERMS = ["oscillation", "oscillatory", "seasonal", "repeating", "periodic", "cyclic"]
FALLBACK = ["add_flat", "add_plateau", "add_ramp", "add_trend", "add_peak", "add_trough", "add_change_point", "add_noise"]
