"""Word lists and patterns of the checks, as text.

All entries are needed as they stand for equal results.  They are data: every operator takes its list
as an argument, so a user can pass another.
"""

# --- fixed values: words and phrases with their plainer forms ---
GRAND_WORDS = {
    "utilize": "use", "utilizes": "uses", "utilized": "used", "utilizing": "using", "utilization": "use",
    "utilisation": "use", "utilise": "use", "utilises": "uses", "utilised": "used", "commence": "begin",
    "commences": "begins", "commenced": "began", "endeavor": "try", "endeavour": "try", "ascertain": "determine",
    "necessitates": "requires", "necessitate": "require", "leverage": "use", "leverages": "uses",
    "leveraged": "used", "elucidate": "clarify", "elucidates": "clarifies", "elucidated": "clarified",
}
#: Grand only as verbs, and the words after which they are nouns.
GRAND_ONLY_AS_VERB = ["leverage", "leverages", "leveraged", "endeavor", "endeavour"]
BEFORE_NOUN = r"(?i)\b(?:a|an|the|this|that|its|their|our|his|her|my|your|of|in|with|by|for|no|more|less|each|any|every|high|low|financial)\s+$"
WORDY_PHRASES = {
    "due to the fact that": "because", "owing to the fact that": "because", "despite the fact that": "although",
    "in spite of the fact that": "although", "in order to": "to", "prior to": "before", "subsequent to": "after",
    "at this point in time": "now", "in the event that": "if", "in close proximity to": "near", "by means of": "by",
    "has the ability to": "can", "have the ability to": "can", "whether or not": "whether",
    "in excess of": "more than", "a majority of": "most", "the majority of": "most", "a large number of": "many",
    "it is possible that": "possibly / may", "in the absence of": "without", "period of time": "period",
}
REDUNDANT_PAIRS = {
    "each and every": "every", "first and foremost": "first", "full and complete": "complete",
    "basic fundamentals": "fundamentals", "end result": "result", "final outcome": "outcome",
    "past history": "history", "advance planning": "planning", "completely eliminate": "eliminate",
    "close proximity": "proximity", "exactly identical": "identical", "general consensus": "consensus",
    "mutual cooperation": "cooperation", "small in size": "small", "brief in duration": "brief",
    "future prospects": "prospects",
}
HYPE_WORDS = ["novel", "cutting-edge", "state-of-the-art", "groundbreaking", "ground-breaking", "paradigm-shifting", "revolutionary", "unprecedented", "game-changing"]
HYPE_TECHNICAL = ["coronavirus", "virus", "pathogen", "variant", "strain", "influenza", "serotype", "antigen", "compound", "species", "host"]
INTENSIFIERS = ["very", "extremely", "really", "incredibly", "hugely", "tremendously", "massively"]
FILLER_PHRASES = [
    "it should be noted that", "it is important to note that", "it is worth noting that", "it is interesting to note that",
    "it must be mentioned that", "needless to say", "as a matter of fact", "it goes without saying that",
]
CONTRACTIONS = [
    "don't", "doesn't", "didn't", "isn't", "aren't", "wasn't", "weren't", "can't", "couldn't", "won't", "wouldn't",
    "shouldn't", "hasn't", "haven't", "hadn't", "it's", "we're", "we've", "we'll", "they're", "there's", "that's",
    "let's", "i'm", "you're", "what's", "who's",
]
HEDGES = [
    "may", "might", "could", "possibly", "potentially", "perhaps", "presumably", "apparently", "seemingly", "arguably",
    "somewhat", "likely", "suggest", "suggests", "suggested", "appear", "appears", "appeared", "seem", "seems",
    "seemed", "tentatively", "conceivably",
]
BOOSTERS = [
    "clearly", "obviously", "certainly", "definitely", "undoubtedly", "always", "never", "must", "evidently", "indeed",
    "conclusively", "definitively", "unquestionably", "demonstrably", "surely", "established", "establishes", "proven",
    "proves",
]
SELF_MENTIONS = ["we", "our", "us", "i", "my"]
OVERCLAIMS = [r"\bproves?\b", r"\bproved\b", r"\bproven\b", r"\bconclusively\b", r"\bdefinitively\b", r"\bunambiguously\b", r"\bbeyond (?:any )?doubt\b", r"\bundoubtedly\b", r"\bestablishes that\b"]
PROOF_WORDS = ["theorem", "lemma", "corollary", "proposition", "conjecture", "axiom", "by induction", "formally", "formal proof", "proof assistant", "coq", "lean", "isabelle", "agda"]
CAUSAL_PHRASES = [r"\bleads? to\b", r"\bled to\b", r"\bresults? in\b", r"\bresulted in\b"]
#: Verb forms that assert causes; those that also describe a change need an object after them.
CAUSAL_FORMS = r"\b(?:cause[sd]?|prevent(?:s|ed)?|protect(?:s|ed)?|affect(?:s|ed)?|impact(?:s|ed)?|mitigate[sd]?|avert(?:s|ed)?|drives?|drove|(?:reduce|increase|decrease|improve|raise)[sd]|(?:lower|worsen)(?:s|ed))\b"
CHANGE_FORMS = r"^(?i:reduce|increase|decrease|improve|raise|lower|worsen)"
AFTER_CHANGE = r"^ (?:the|a|an|this|that|its|their|these|those) "
#: What before such a form makes it an aim, a calibrated claim, or the authors' own act.
BEFORE_CALIBRATED = r"(?i)\b(?:to|may|might|could|would|can|we|i|authors?)\s+$"
BEFORE_SIGNIFICANT = r"(?i)(?:statistically|clinically|epidemiologically|biologically|practically)\s*$"
PROOF = r"\b(?:" + "|".join(PROOF_WORDS) + r")\b"
ASSERTIVES = [r"\bclearly\b", r"\bobviously\b", r"\bof course\b", r"\bevidently\b", r"\bit is clear that\b", r"\bit is obvious that\b"]
LIGHT_VERBS = ["perform", "conduct", "make", "carry", "undertake", "execute", "do", "provide", "achieve", "accomplish"]
NOMINAL_VERBS = {
    "estimation": "estimate", "comparison": "compare", "analysis": "analyse", "analyses": "analyse",
    "investigation": "investigate", "assessment": "assess", "evaluation": "evaluate", "examination": "examine",
    "measurement": "measure", "calculation": "calculate", "computation": "compute", "implementation": "implement",
    "identification": "identify", "validation": "validate", "simulation": "simulate", "estimations": "estimate",
    "comparisons": "compare", "calibration": "calibrate", "optimization": "optimise", "optimisation": "optimise",
    "adjustment": "adjust", "determination": "determine", "prediction": "predict", "description": "describe",
    "collection": "collect", "selection": "select", "derivation": "derive",
}
NOMINAL_SUFFIXES = ["tion", "sion", "ment", "ance", "ence", "ency", "ancy"]
NOMINAL_ALLOWED = [
    "attention", "information", "population", "distribution", "proportion", "question", "section", "equation",
    "function", "position", "condition", "government", "environment", "moment", "element", "document", "experiment",
    "department", "instrument", "treatment", "science", "evidence", "confidence", "difference", "prevalence",
    "incidence", "influence", "absence", "presence", "sentence", "reference", "transmission", "emission", "session",
    "profession", "dimension", "infection", "intervention", "vaccination", "surveillance", "variance", "importance",
    "significance", "frequency", "tendency", "emergency", "agency", "region", "religion", "version", "mention",
]
TRAILING_QUALIFIERS = [r", according to [^,.;]+$", r", as (?:shown|seen|reported|illustrated|demonstrated) (?:in|by) [^,.;]+$", r", in (?:our|this) (?:study|analysis|simulations?|model)$"]
EMPTY_PHRASES = [
    "holistic understanding", "comprehensive understanding of the complex", "sheds light on", "shed light on",
    "shedding light on", "paves the way for", "pave the way for", "provides valuable insights into",
    "provide valuable insights into", "provides important insights into", "helps to inform", "help to inform",
    "a wide range of applications",
]
NAKED_THIS_VERBS = [
    "is", "was", "has", "can", "could", "may", "might", "will", "would", "suggests", "indicates", "means", "implies",
    "shows", "demonstrates", "allows", "highlights", "raises", "reflects", "leads", "led", "results", "resulted",
    "supports", "confirms", "underscores",
]
CONSENSUS = r"\b(?:is|are)\s+(?:widely\s+|generally\s+|commonly\s+)?(?:known|considered|believed|thought|recognized|recognised|regarded|assumed)\s+to\b"
CITATION = r"\[\d|\(\d{4}|\bet al\b|\(\w+ (?:and|&) \w+,? \d{4}"
NOVELTY = (
    r"\b(?:has|have)\s+(?:never\s+|not\s+)(?:yet\s+)?been\s+(?:studied|investigated|explored|examined|reported|done|addressed|quantified|characteri[sz]ed|assessed)\b"
    r"|\bno\s+(?:prior\s+|previous\s+)?(?:study|studies|work|research)\s+(?:has|have|exists?)\b"
)
SOFTENERS = ["to our knowledge", "to the best of our knowledge", "as far as we are aware", "we are not aware"]
FIGURE_OPENER = r"^\s*(?:Figure|Fig\.?|Table|Supplementary\s+(?:Figure|Table))\s+\S+\s+(?:shows?|presents?|displays?|illustrates?|depicts?|summari[sz]es?|provides?|gives?|lists?)\b"
ABSTRACT_VAGUE = r"\b(?:results?|findings?|implications?|data|outcomes?)\s+(?:will|shall)\s+be\s+(?:discussed|presented|explored|described|reported|examined)\b"
SERIAL_SUMMARY = [
    r"\bthere\s+(?:are|have\s+been|is\s+a\s+growing\s+body\s+of)\s+(?:many|several|numerous|various|a\s+number\s+of)?\s*(?:studies|articles|papers|reports|researchers|works?)\b",
    r"\bmuch\s+research\s+has\s+been\s+(?:done|conducted|carried\s+out)\b",
    r"\bmany\s+(?:studies|researchers|authors|scholars)\s+have\s+(?:studied|investigated|examined|explored|looked\s+at|reported)\b",
]
CONTRAST = r"\b(however|although|nevertheless|yet|whereas|despite|in contrast|but)\b"
GAP = (
    r"\b(limited|few(er)? studies|little (is known|attention|work)|remains? (unclear|unknown|unexplored|unquantified|to be (seen|determined))|not (yet )?been"
    r"|no (prior |previous )?(study|studies|work|research)|gap|understudied|overlooked|paucity|scarce)\b"
)
ADVERSATIVE = r"^\s*(However|Nevertheless|Nonetheless|Yet|On the other hand|Conversely)\b[, ]"
EXPLETIVE = r"^\s*(There (?:is|are|was|were|has been|have been)\b|It (?:is|was) \w+ that\b)"
ACRONYM = r"\b[A-Z]{2,6}s?\b"
ROMAN = r"^(?=[IVX]{2,}$)X{0,3}(?:IX|IV|V?I{0,3})$"
#: A line of an abbreviation list; a word in capitals.
LISTED_ACRONYM = r"(?m)^\s*([A-Z]{2,6})s?\s*(?:[—–:\-]|\s{2,})\s*[A-Z(]"
CAPITAL_WORD = r"[A-Z][A-Z&'’-]+"
ACRONYMS_ALLOWED = [
    "USA", "UK", "US", "EU", "UN", "PDF", "DOI", "URL", "ID", "AI", "IT", "DNA", "RNA", "HIV", "AIDS", "COVID", "SARS",
    "MERS", "PCR", "WHO", "CDC", "NHS", "NIH", "ICU", "BMI", "CI", "SD", "SE", "IQR", "OR", "RR", "HR", "AIC", "BIC",
    "MCMC", "ESS", "HMC", "NUTS", "GLM", "GAM", "ODE", "SIR", "SEIR", "SEIRD", "GDP", "UV", "ROC", "AUC", "BMJ", "BMC",
    "PLOS", "JAMA", "NEJM", "SGD", "USD", "EUR", "GBP", "CNY", "JPY", "INR", "MYR", "IDR", "THB",
]
VARIANT_PAIRS = [
    ("modelling", "modeling"), ("modelled", "modeled"), ("behaviour", "behavior"), ("behaviours", "behaviors"),
    ("analyse", "analyze"), ("analysed", "analyzed"), ("analysing", "analyzing"), ("analyses", "analyzes"),
    ("organisation", "organization"), ("organisations", "organizations"), ("optimisation", "optimization"),
    ("optimise", "optimize"), ("optimised", "optimized"), ("parameterisation", "parameterization"),
    ("hospitalisation", "hospitalization"), ("hospitalisations", "hospitalizations"), ("colour", "color"),
    ("colours", "colors"), ("labelled", "labeled"), ("labelling", "labeling"), ("centre", "center"),
    ("centres", "centers"), ("standardised", "standardized"), ("standardise", "standardize"),
    ("characterised", "characterized"), ("characterise", "characterize"), ("summarised", "summarized"),
    ("summarise", "summarize"), ("generalisability", "generalizability"), ("immunisation", "immunization"),
    ("randomised", "randomized"), ("categorised", "categorized"), ("visualisation", "visualization"),
    ("neighbourhood", "neighborhood"), ("neighbourhoods", "neighborhoods"), ("favourable", "favorable"),
    ("favour", "favor"),
]
SECTION_PATTERNS = [
    (r"^\W*(references|bibliography|literature cited|works cited|reference list|cited literature)\W*$", "references"),
    (r"appendix|appendices|supplement", "appendix"),
    (r"abstract|summary\b", "abstract"),
    (r"introduction|background", "introduction"),
    (r"method|material|model|data\b|analys[ie]s|estimation|inference|statistic|design|setting|participants", "methods"),
    (r"result|finding", "results"),
    (r"limitation", "limitations"),
    (r"discussion", "discussion"),
    (r"conclusion", "conclusion"),
]
SECTION_NAME_WORDS = (
    "abstract summary introduction background literature review aims aim objectives methods method methodology materials "
    "material data statistical statistics analysis analyses experimental procedures results result findings discussion "
    "general conclusion conclusions concluding remarks limitations strengths appendix appendices supplementary supplemental "
    "information references bibliography"
).split()
SECTION_NAME_FILLER = ["and", "of", "the", "a", "an", "s"]
NUMBERING = r"^\s*(?:(?:chapter|part|section|appendix)\s+)?(?:[0-9]+|[ivxlc]+|[a-z])(?:[.:][0-9]+)*[.:)]?\s+"
UNITS = ["%", "°C", "mg", "kg", "mL", "ml", "µg", "μg", "ng", "km", "cm", "mm", "kDa", "Hz", "kHz", "mmHg"]

# --- fixed values: sentence roles, most argumentative first, and their signals ---
ROLE_SIGNALS = {
    "limitation": [r"\blimitations?\b", r"\bwe (could|can) ?not\b", r"\bwe were unable to\b", r"\bcaution\b", r"\bcaveats?\b", r"\bshould be interpreted (with|in light)\b", r"\bmay not (generali[sz]e|apply|hold|capture)\b", r"\bis (subject|prone) to\b.*\bbias\b", r"\bunmeasured\b", r"\bresidual confounding\b", r"\bsmall sample\b", r"\bdata (were|was|are|is) not available\b"],
    "rebuttal": [r"\bone might (argue|object|expect)\b", r"\bit could be argued\b", r"\ban alternative explanation\b", r"\bcontrary to\b", r"\bhowever, .*\b(not|cannot|unlikely)\b", r"\bthis does not (imply|mean|establish)\b"],
    "contribution": [r"\b(our|this|the) (study|paper|thesis|work|analysis) (contributes?|adds?|extends?|provides?|offers?|advances?)\b", r"\bto (our|the best of our) knowledge\b", r"\bfor the first time\b", r"\bnovel\b", r"\bfills? (a|an|this|the) gap\b", r"\bstrengths? of (this|our) (study|approach)\b"],
    "implication": [r"\bimplications?\b", r"\binform(s|ing)? (policy|practice|decision|planning|control|surveillance|guidelines)\b", r"\b(policymakers|clinicians|public health|practitioners) (could|can|should|may|need)\b", r"\bfuture (research|studies|work) (should|could|is needed)\b", r"\bthese (findings|results) (suggest|highlight|underscore) the (need|importance|value)\b"],
    "warrant": [r"\bbecause\b", r"\bsince\b.*\b(we|this|these|it)\b", r"\bthis (suggests?|indicates?|implies|means) that\b", r"\bconsistent with\b", r"\bin line with\b", r"\bas (expected|predicted) (from|by|under)\b", r"\bwhich (explains?|accounts? for|supports?)\b", r"\bunder (the|this|these) assumptions?\b", r"\btherefore\b", r"\bhence\b", r"\bthus\b"],
    "claim": [r"\bwe (argue|contend|propose|conclude|claim|maintain)\b", r"\b(demonstrates?|establishes?|proves?|confirms?) that\b", r"\b(causes|caused|drives|drove|leads to|led to|results in|reduces|increases|prevents|explains)\b", r"\bis (essential|critical|necessary|key|central) (to|for)\b", r"\b(should|must) (be|not)\b"],
    "result": [r"\bwe (found|find|observed|estimate[d]? that|identified)\b", r"\bresults? (show|showed|indicate[d]?|reveal(ed)?)\b", r"\bwas (significantly )?(associated|correlated|linked)\b", r"\b95\s?% (ci|cri|credible|confidence)\b", r"\b(odds|risk|hazard|rate) ratio\b", r"\b(increased|decreased|reduced|higher|lower) (than|by|among|in)\b"],
    "method": [r"\bwe (used|use|fitted|fit|conducted|developed|applied|analy[sz]ed|model(led|ed)|simulated|estimated|calibrated|implemented|assumed)\b", r"\bdata (from|were|was)\b", r"\b(seir|sir|compartmental|branching process|regression|agent-based|transmission) model\b", r"\bwere (recruited|collected|included|enrolled|randomi[sz]ed)\b", r"\bpriors? (were|was|on)\b", r"\blikelihood\b", r"\bsensitivity analys[ie]s\b"],
    "evidence": [r"\b\d+(\.\d+)?\s?%", r"\bp\s?[<=>]\s?0?\.\d+\b", r"\bn\s?=\s?\d+", r"\btable \d+\b", r"\bfigure \d+\b", r"\bet al\b", r"\((19|20)\d{2}\)", r"\[\d+([,–-]\s?\d+)*\]", r"\bpreviously (reported|shown|estimated)\b", r"\bin (a|an|the) (previous|prior|earlier) (study|analysis)\b"],
    "qualifier": [r"\bmay\b", r"\bmight\b", r"\bcould\b", r"\bappears? to\b", r"\bseems? to\b", r"\bis likely to\b", r"\bprobably\b", r"\bto some extent\b", r"\bin (most|some) (cases|settings)\b", r"\bconditional on\b", r"\bif .* holds?\b"],
    "background": [r"\bis (a|an|the) (leading|major|common|important)\b", r"\bhas been (widely|extensively) (studied|used|reported)\b", r"\bit is (well[- ])?(known|established|recognised|recognized)\b", r"\bremains? (a|an|the)\b.*\b(burden|challenge|threat)\b", r"\bworldwide\b", r"\bglobally\b", r"\beach year\b"],
}
ARGUED_SECTIONS = ["introduction", "results", "discussion", "conclusion"]

# --- fixed values: signals of the moves of an abstract, each looked for in a sentence; its opening is told by aim and methods ---
ABSTRACT_SIGNALS = {
    "gap": [r"\bhowever\b", r"\balthough\b", r"\byet\b", r"\bnevertheless\b", r"\bremains? (unclear|unknown|unexplored|unquantified|limited|uncertain|to be)\b", r"\b(has|have) (not|never|yet to)\b", r"\blittle is known\b", r"\bfew(er)? studies\b", r"\blimited (evidence|research|data|understanding|insight)\b", r"\bgap\b", r"\bpaucity\b", r"\bunderstudied\b", r"\boverlooked\b", r"\bhas yet to (explain|address|examine|quantify)\b", r"\bpropensity to\b.*\bchallenge\b", r"\bconcern\b"],
    "aim": [r"\bwe (ask|asked|aim|aimed|sought|set out|investigate|investigated|examine|examined|assess|assessed|evaluate|evaluated|explore|explored|quantify|quantified|characteri[sz]ed?|test|tested|hypothesi[sz]ed?|study|studied|expand)\b", r"\bthis (paper|study|thesis|dissertation|work) (asks|aims|investigates|examines|assesses|evaluates|explores|quantifies|addresses|seeks|expands|proposes)\b", r"\b(our|the) (objective|aim|goal|purpose)s? (of this study )?(was|were|is|are)\b", r"\bthe aims? of this (study|paper|thesis)\b", r"\bresearch question\b", r"\bhere,? we\b", r"\bto (address|answer|fill|investigate|determine|understand) (this|these|whether|the)\b"],
    "methods": [r"\bwe (used|use|fitted|fit|conducted|developed|applied|analy[sz]ed|model(led|ed)|simulated|estimated|recruited|collected|compared|combined|shortlisted|graded|surveyed|interviewed|reviewed|screened|extracted|calibrated|implemented)\b", r"\busing (a|an|the|data|survey|model|regression|bayesian|interviews?|case stud)\b", r"\bdata (from|were|was)\b", r"\bwere (recruited|collected|included|enrolled|analy[sz]ed|extracted|graded|randomi[sz]ed)\b", r"\b(cohort|cross-sectional|randomi[sz]ed|case-control|longitudinal|retrospective|prospective) (study|trial|design|survey|analysis)\b", r"\b(seir|sir|compartmental|branching process|regression|agent-based) model\b"],
    "findings": [r"\bwe (found|find|observed|identified|estimate[d]? that|show|showed|demonstrate[d]?|report)\b", r"\bresults? (show|showed|indicate[d]?|reveal(ed)?|suggest(ed)?)\b", r"\bwas (significantly )?(associated|correlated|linked)\b", r"\b(higher|lower|greater|increased|decreased|reduced) (than|by|among|in)\b", r"\b\d+(\.\d+)?\s?%", r"\b95\s?% (ci|cri|credible|confidence)\b", r"\b(odds|risk|hazard|rate) ratio\b", r"\bscored? (significantly )?(higher|lower)\b", r"\bcompared (with|to)\b.*\b\d"],
    "significance": [r"\bthese (findings|results|data) (suggest|indicate|imply|highlight|underscore|demonstrate|reinforce|point)\b", r"\bour (study|findings|results) (demonstrates?|suggests?|highlights?|provides?|underscores?)\b", r"\bimplications?\b", r"\binform(ing|s)? (policy|practice|decision|planning|control|surveillance|guidelines)\b", r"\bfuture (research|studies|work)\b", r"\b(clinicians|policymakers|public health|practitioners|researchers) (could|can|should|may|need)\b", r"\bpotential (role|use|application|value)\b", r"\bcontribut(es?|ion) to\b", r"\bmust (change|adapt|reconsider)\b"],
}
ABSTRACT_MOVES = ["background", "gap", "aim", "methods", "findings", "significance"]

# --- fixed values: rhetorical moves, their order by section, where order counts, and the move an opening makes ---
GAP_CONTRAST = "however although yet but nevertheless despite".split()
GAP_LACK = ["unclear", "unknown", "unexplored", "unquantified", "uncertain", "not been", "rarely", "seldom", "lacking", "lack of", "missing", "neglected"]
MOVE_SIGNALS = {
    "territory": [*ROLE_SIGNALS["background"], r"\b(is|are|remains?) (a|an|the|among the) (major|leading|significant|growing|important|common|key)\b", r"\b(affects?|affecting|infects?) (millions|thousands|\d[\d,.]* (million|thousand|people))\b", r"\b(public health|clinical|economic) (burden|importance|priority|concern)\b"],
    "gap": [r"\bremains? (unclear|unknown|unexplored|unquantified|limited|uncertain|poorly understood|to be (seen|determined|established))\b", r"\blittle is known\b", r"\bfew(er)? studies\b", r"\b(has|have) (not|never|yet to) been\b", r"\bhas yet to\b", r"\blimited (evidence|research|data|understanding|insight)\b", r"\bgap in (the |our )?(literature|knowledge|understanding)\b", r"\bpaucity\b", r"\bunderstudied\b", r"\boverlooked\b", r"\bno (study|studies|previous work) (has|have)\b", r"\bwhat remains (unclear|unknown)\b", rf"\b({'|'.join(GAP_CONTRAST)})\b[^\n]*\b({'|'.join(GAP_LACK)})\b", rf"\b({'|'.join(GAP_LACK)})\b[^\n]*\b({'|'.join(GAP_CONTRAST)})\b"],
    "aim": [*ABSTRACT_SIGNALS["aim"], r"\bwe (therefore|thus|then|here|first|also|now) (aim|aimed|set out|sought|seek|investigate|investigated|examine|examined|estimate|estimated|test|tested|ask|asked|quantify|quantified|assess|assessed|explore|explored)\b", r"\b(the present|this) (study|paper|work|analysis|chapter) (aims?|aimed|sets? out|seeks|sought|estimates?|quantifies|tests?|asks?|examines?|investigates?|explores?)\b", r"\bour (aim|objective|goal|purpose|question) (was|is|were)\b"],
    "background": ROLE_SIGNALS["background"],
    "methods": ABSTRACT_SIGNALS["methods"],
    "findings": ABSTRACT_SIGNALS["findings"],
    "significance": ABSTRACT_SIGNALS["significance"],
    "data": [r"\bdata (from|were|was|on|set)\b", r"\bdataset\b", r"\bwere (recruited|collected|included|enrolled|obtained|extracted|reported|sampled)\b", r"\b(surveillance|case (counts|notifications|reports)|registry|cohort|survey|census|time series)\b", r"\bwe (collected|obtained|used|extracted|compiled|assembled) (the |weekly |daily |monthly )?(data|counts|records|cases)\b"],
    "analysis": [r"\bwe (fitted|fit|developed|applied|analy[sz]ed|model(led|ed)|simulated|estimated|calibrated|implemented|assumed|compared|computed|derived|specified|sampled)\b", r"\b(seir|sir|compartmental|branching process|regression|agent-based|transmission|renewal|bayesian|hierarchical|mixed) model\b", r"\b(likelihood|posterior|priors?|markov chain|mcmc|least squares|maximum likelihood|sensitivity analys[ie]s)\b", r"\bwas (fitted|estimated|modelled|modeled|computed|derived|calculated|simulated|calibrated)\b"],
    "evidence": ROLE_SIGNALS["evidence"],
    "summary": [r"\b(in this (study|paper|work|thesis|chapter)|here),? we\b", r"\b(we|this study|our (model|analysis|results|estimates|fit))\b[^.;]*\b(found|find|show|showed|shows|suggest|suggests|estimated|reproduced|demonstrated|identified) (that|how|whether|no|a|the)\b", r"\b(we|our (results|findings|analysis|model)) (found|find|show|showed|shows|suggest|suggests|estimate|estimated|demonstrate|demonstrated|observed|report)\b", r"\b(our|the) (main|key|principal|central) (finding|result)s?\b"],
    "interpretation": ROLE_SIGNALS["warrant"],
    "comparison": [r"\b(consistent|in line|in agreement|in keeping|at odds|in contrast|compared) with (previous|prior|earlier|other|those|estimates|findings|reports|studies|work)\b", r"\b(previous|prior|earlier|other) (studies|work|estimates|reports|analyses)\b", r"\bet al\b", r"\((19|20)\d{2}[a-z]?\)", r"\b(agrees?|agreed|differs?|differed|contrasts?) (with|from)\b", r"\b(higher|lower|larger|smaller|similar) (than|to) (those|that|estimates|values) (reported|found|observed)\b"],
    "limitations": ROLE_SIGNALS["limitation"],
    "implications": [*ROLE_SIGNALS["implication"], *ABSTRACT_SIGNALS["significance"], r"\b(practical|policy|clinical|operational) (use|uses|implications?|value|relevance|consequences?)\b", r"\bcould be (run|used|applied|adopted|repeated|extended) (at|by|in|to|for|before|after|each|every)\b", r"\b(could|would|should|can) (be used to |help to |serve to )?(rank|prioriti[sz]e|target|guide|inform|time|plan|allocate|focus|direct|support) \b", r"\b(would|could) have the (most|greatest|largest) (effect|impact|benefit)\b", r"\b(the|each) next (season|outbreak|epidemic|wave|step|study)\b"],
    "contribution": [*ROLE_SIGNALS["contribution"], r"\b(the|this|our) (approach|method|model|framework|analysis|study|work) (needs|requires|provides|offers|allows|makes it possible|enables|adds|extends|shows|showed|demonstrates|is the first)\b", r"\b(we|this work|this paper) (provide|present|introduce|propose|extend|offer|report) (a|an|the|new)\b"],
}
SECTION_MOVES = {
    "abstract": ["background", "gap", "aim", "methods", "findings", "significance"],
    "introduction": ["territory", "gap", "aim"],
    "methods": ["data", "analysis"],
    "results": ["findings", "evidence"],
    "discussion": ["summary", "interpretation", "comparison", "limitations", "implications"],
    "limitations": ["limitations"],
    "conclusion": ["contribution", "implications"],
}
ORDERED_SECTIONS = ["abstract", "introduction"]
OPENING_MOVES = {"abstract": "background", "introduction": "territory"}

# --- fixed values: numbers quoted from tables, and what is not a quoted number ---
SUMMED = r"(?i)\b(?:altogether|in total|overall|combined|together|cumulative|sum of|of all)\b"
LEVEL_AFTER = r"(?i)^\s*(?:CI|CrI|UI|PI|HDI|confidence|credible|uncertainty|prediction|significance)\b"
LEVEL_BEFORE = r"(?:\bp|\bP|α|alpha|level of)\s*[<>=≤≥]?\s*$"
# --- fixed values: captions of word-processor documents, and words that begin no body text ---
CAPTION_HEAD = r"^\s*(Fig(?:ure)?\.?|Table)\s+(\d+)"
CAPTION_TYPED = r"^\s*(?:Fig(?:ure)?\.?|Table)\s+\d+\s*[.:]\s+\S"
CAPTION_LISTED = r"(?:\.{3,}|…|\t)\s*\d+\s*$"
CAPTION_CONTINUED = r"(?i)\(?\bcont(?:inued|'d|\.)\)?\s*[.:]?\s*$"
RANGE_MARK = r"^\s*(?:-{1,3}|–|—|to)\s*$"
