"""Fixed values that results depend on."""

# --- fixed values: closed vocabularies ---
FUNCTION_WORDS = (
    "a about above across after against all although am among an and any are as at be because been before being below beneath beside between beyond both but by can cannot could did do does doing done down "
    "during each either few for from had has have having he her hers herself him himself his how i if in into is it its itself may me might must my myself neither nor not of off on once one or other ought our "
    "ours ourselves out over own per shall she should since so some such than that the their theirs them themselves then there these they this those though through throughout to too toward towards under unless "
    "until unto up upon us was we were what when whence where whereas whether which while who whom whose why will with within without would you your yours yourself yourselves"
).split()
CLAUSE_MARKERS = "that which who whom whose because although though while whereas since unless until whether if when where after before as".split()
CONTRACTION_SUFFIXES = ("n't", "'re", "'ve", "'ll", "'d", "'m")
S_HOSTS = "it he she that there here what who where when how let".split()
NEGATIONS = "cannot neither never no nobody none nor not nothing nowhere without".split()
NEGATIVE_CONTRACTIONS = "aren't can't couldn't didn't doesn't don't hadn't hasn't haven't isn't shouldn't wasn't weren't won't wouldn't".split()
URL_TRAILERS = ".,;:!?)]}\"'”’"

# --- fixed values: the shipped lint rules (id, severity, pattern), all unvalidated; double-space is of the category formatting, the others of author-deviation ---
LINT_RULES = [
    ("double-space", "warn", "  "),
    ("double-click", "warn", "(?i)double[- ]click(ing)? (on|into)"),
    ("north-star", "warn", "(?i)north[- ]star"),
    ("move-the-needle", "warn", "(?i)mov(e|ing|ed) the needle"),
    ("circle-back", "warn", "(?i)circl(e|ing|ed) back"),
    ("at-the-end-of-the-day", "warn", "(?i)at the end of the day[,]"),
    ("leverage-abstraction", "warn", "(?i)leverag(e|ing|ed) (our|their|your|the|its) [a-z]"),
    ("unlock-value", "warn", "(?i)(unlock|driv(e|ing)|deliver(ing)?) (significant |real |meaningful |exponential )?(value|impact|growth|outcomes)"),
    ("core-competency", "warn", "(?i)(core competenc(y|ies)|synerg(y|ies)|the bandwidth to)"),
    ("stakeholder-empowerment", "warn", "(?i)(empower(ing)? (stakeholder|team|user|customer)|stakeholder (buy-?in|alignment))"),
    ("operationalize", "warn", "(?i)(operationaliz|incentiviz|socializ)(e|ing|ed)"),
    ("paradigm-shift", "warn", "(?i)(paradigm shift|game[- ]chang(er|ing)|best[- ]in[- ]class|world[- ]class)"),
    ("at-scale", "info", "(?i)[a-z] at scale"),
    ("important-to-note", "warn", "(?i)it('s| is) (important|worth) (to note|noting|remembering|mentioning)"),
    ("delve", "warn", "(?i)(delv(e|ing)|div(e|ing) deep|deep[- ]div(e|ing)|unpack(ing)? (this|that|the))"),
    ("not-just-but", "warn", "(?i)not (just|merely|only) [^.!?]{3,60}(—|--|,) (but|it'?s)"),
    ("in-todays-landscape", "warn", "(?i)in today'?s ([a-z-]+ )?(world|landscape|environment|market|era)"),
    ("testament-to", "warn", "(?i)(a testament to|speaks volumes|stands as a)"),
    ("navigate-complexities", "warn", "(?i)(navigat(e|ing) the (complex|landscape|challeng)|the landscape of)"),
    ("crucial-role", "warn", "(?i)(play(s|ing)? an? (crucial|vital|pivotal|key|significant) role|an? key (aspect|component|factor))"),
    ("furthermore-stack", "info", "(?i)^(furthermore|moreover|additionally|in conclusion|that said|that being said|ultimately),"),
    ("robust-comprehensive", "warn", "(?i)(robust|comprehensive|seamless|holistic|cutting[- ]edge|state[- ]of[- ]the[- ]art) (and )?(robust|comprehensive|seamless|holistic|solution|approach|framework|experience)"),
]

# --- fixed values: seeds, sizes and levels ---
#: This library's own; seeds are parameters.
BOOTSTRAP_SEED = 20_260_401
RESAMPLES, CONFIDENCE, MIN_QUALIFIED = 2000, 0.95, 0.90
AUTHOR_TARGET, DISTRACTOR_TARGET, AUC_FLOOR = 0.05, 0.10, 0.80
MIN_LEXICAL, MIN_OBSERVATIONS, MIN_PARAGRAPHS, MIN_DOCUMENTS, MIN_REFERENCE, MIN_FEATURES = 10, 30, 30, 3, 30, 4
MAD_SCALE, SCRIPT_CEILING, SCRIPT_ESTABLISHED, EXPANSION, EPSILON = 1.4826, 0.05, 0.25, 1.5, 1e-9
SPLIT_WEIGHTS = (("train", 8), ("calibrate", 1), ("test", 1))
MIN_SENTENTIAL, MIN_UNPUNCTUATED = 4, 8

FEATURES = ("word_length_mean", "comma_density", "semicolon_density", "colon_density", "function_word_rate", "clause_marker_rate")
