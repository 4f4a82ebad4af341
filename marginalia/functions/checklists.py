"""Signals of four published reporting checklists (one regular expression list an item, over one
sentence, any case), the sections where readers look for the item, and the cue of the kind of study."""

from __future__ import annotations

INTRO, METHODS, RESULTS = ["introduction", "abstract"], ["methods"], ["results"]
DISCUSSION = ["discussion", "limitations", "conclusion"]
FRONT = ["abstract", "front", "unknown", "other"]
ANYWHERE: list[str] = []

DATES = [r"\b(19|20)\d\d\b"]
AIM = [r"\b(we|this study|this paper|this analysis)\b[^.]{0,40}\b(aim|aimed|set out|sought|seek|hypothesi[sz]ed?|investigat|examin|estimat|assess|evaluat|quantif|test)", r"\b(objective|aim|purpose|hypothesis)\b"]
LIMITS = [r"\blimitations?\b", r"\bcaveat", r"\bwe (could|can) ?not\b", r"\bshould be interpreted (with|in light)\b"]
FUNDING = [r"\bfund(ed|ing|er)\b", r"\bgrant\b", r"\bsupported by\b", r"\bfinancial support\b"]
SAMPLE = [r"\bsample size\b", r"\bpower (calculation|analysis)\b", r"\bstudy size\b", r"\b\d+% power\b", r"\bpowered to\b"]
ELIGIBILITY = [r"\beligib", r"\binclusion criteria\b", r"\bexclusion criteria\b", r"\bwere (included|excluded) (if|when|because)\b", r"\b(aged|age) (\d+|between)\b"]
INTERVALS = [r"\b9[059]\s?%\s?(ci|cri|confidence|credible|uncertainty|prediction)", r"\b(confidence|credible|prediction|uncertainty) intervals?\b"]

#: In the order in which cues are tried: the most specific kind of study first.
CUES = {
    "prisma": r"\bsystematic (literature )?review\b|\bmeta-analys[ie]s\b",
    "consort": r"\brandomi[sz]ed (controlled |clinical )?trial\b|\brandomly (assigned|allocated)\b",
    "epiforge": r"\b(forecast(s|ed|ing)?|nowcast(s|ed|ing)?|projections?)\b[^.]{0,50}\b(epidemic|outbreak|cases|incidence|hospitali[sz]ations|admissions|deaths|peak|transmission)\b|\bscenario model",
    "strobe": r"\b(cohort|case-control|cross-sectional|observational) (study|design|analysis|survey)\b",
}

#: checklist -> (item, signals, sections; none: anywhere)
ITEMS: dict[str, list[tuple[str, list[str], list[str]]]] = {
    "strobe": [
        ("design", [r"\b(cohort|case-control|cross-sectional|ecological|observational) (study|design|analysis|survey)\b"], FRONT + INTRO),
        ("objectives", AIM, INTRO),
        ("setting", DATES, METHODS),
        ("participants", [*ELIGIBILITY, r"\brecruit", r"\bselected\b", r"\benrolled\b"], METHODS),
        ("variables", [r"\b(outcome|exposure|confounder|covariate|effect modifier)s?\b", r"\bdefined as\b"], METHODS),
        ("measurement", [r"\bmeasured\b", r"\bquestionnaire\b", r"\bregist(er|ry)\b", r"\b(medical|health|clinical) records\b", r"\bsurveillance\b", r"\bdata (were|was) (obtained|collected|extracted|drawn)\b"], METHODS),
        ("bias", [r"\bbias(es|ed)?\b"], METHODS + DISCUSSION),
        ("study-size", SAMPLE, METHODS),
        ("statistics", [r"\bregression\b", r"\badjust(ed|ing|ment) for\b", r"\bstratif", r"\bpropensity\b", r"\bstatistical analys"], METHODS),
        ("missing-data", [r"\bmissing (data|values|information|observations)\b", r"\bimput", r"\bcomplete[- ]case\b"], METHODS + RESULTS),
        ("flow", [r"\b\d[\d,]*\s+(participants|patients|individuals|people|children|adults|cases|households)\b[^.]{0,60}\b(were )?(included|excluded|eligible|enrolled|analysed|analyzed|followed)\b", r"\blost to follow[- ]up\b", r"\bflow (diagram|chart)\b"], RESULTS),
        ("descriptive", [r"\bcharacteristics\b", r"\b(median|mean) age\b", r"\bbaseline\b"], RESULTS),
        ("estimates", [*INTERVALS, r"\b(odds|hazard|risk|rate) ratio\b"], RESULTS),
        ("limitations", LIMITS, DISCUSSION),
        ("generalisability", [r"\bgenerali[sz]", r"\bexternal validity\b", r"\b(apply|applicable|transferable) to\b", r"\bother (settings|populations|countries|regions)\b"], DISCUSSION),
        ("funding", FUNDING, ANYWHERE),
    ],
    "consort": [
        ("design", [r"\brandomi[sz]ed\b", r"\brandomly\b"], FRONT + INTRO),
        ("objectives", AIM, INTRO),
        ("trial-design", [r"\b(parallel|crossover|cross-over|cluster|factorial|stepped[- ]wedge)\b", r"\ballocation ratio\b", r"\b\d:\d\b"], METHODS),
        ("participants", ELIGIBILITY, METHODS),
        ("interventions", [r"\binterventions?\b", r"\bcontrol (group|arm)\b", r"\bplacebo\b", r"\b(usual|standard) care\b", r"\b(received|were given|was given)\b"], METHODS),
        ("outcomes", [r"\bprimary (outcome|end ?point)\b", r"\bsecondary (outcome|end ?point)s?\b"], METHODS),
        ("sample-size", SAMPLE, METHODS),
        ("sequence", [r"\b(random|randomisation|randomization) (number|sequence|list|schedule)\b", r"\bcomputer[- ]generated\b", r"\b(block|stratified|permuted) randomi"], METHODS),
        ("concealment", [r"\bconceal", r"\bsealed\b[^.]{0,30}\benvelopes?\b", r"\bcentral(ly|ised|ized)? randomi"], METHODS),
        ("blinding", [r"\bblind(ed|ing)?\b", r"\bmasked\b", r"\bopen[- ]label\b"], METHODS),
        ("statistics", [r"\bintention[- ]to[- ]treat\b", r"\bper[- ]protocol\b", r"\bregression\b", r"\bstatistical analys", r"\bcompared\b"], METHODS),
        ("flow", [r"\b\d[\d,]*\s+(participants|patients|people|children|adults)\b[^.]{0,60}\b(were )?(randomi[sz]ed|allocated|assigned|analysed|analyzed)\b", r"\blost to follow[- ]up\b", r"\bdiscontinued\b", r"\bflow (diagram|chart)\b"], RESULTS),
        ("recruitment", DATES, METHODS + RESULTS),
        ("estimates", [*INTERVALS, r"\b(relative|absolute) risk\b", r"\brisk difference\b", r"\bdifference (between|in)\b"], RESULTS),
        ("harms", [r"\badverse (event|effect|reaction)s?\b", r"\bharms?\b", r"\bside[- ]effects?\b", r"\bsafety\b"], ANYWHERE),
        ("limitations", LIMITS, DISCUSSION),
        ("registration", [r"\bregist(ered|ration|ry)\b", r"\bNCT\d{6,}\b", r"\bISRCTN\d+\b", r"\bprotocol\b"], ANYWHERE),
        ("funding", FUNDING, ANYWHERE),
    ],
    "prisma": [
        ("design", [r"\bsystematic (literature )?review\b", r"\bmeta-analys"], FRONT + INTRO),
        ("objectives", AIM, INTRO),
        ("eligibility", [*ELIGIBILITY, r"\bstudies were (eligible|included)\b"], METHODS),
        ("sources", [r"\b(pubmed|medline|embase|scopus|web of science|cochrane|cinahl|psycinfo|google scholar|lilacs)\b", r"\bdatabases?\b[^.]{0,40}\bsearched\b"], METHODS),
        ("search", [r"\bsearch (strategy|terms|string|strings)\b", r"\bboolean\b", r"\bmesh\b", r"\bkeywords?\b"], METHODS),
        ("selection", [r"\bindependently\b", r"\btwo (reviewers|authors|investigators)\b", r"\bscreened\b", r"\btitles? and abstracts?\b"], METHODS),
        ("extraction", [r"\bextract(ed|ion)\b", r"\bdata collection\b"], METHODS),
        ("risk-of-bias", [r"\brisk of bias\b", r"\bquality assessment\b", r"\bnewcastle[- ]ottawa\b", r"\brob ?2\b", r"\bcritical appraisal\b"], METHODS),
        ("synthesis", [r"\brandom[- ]effects?\b", r"\bfixed[- ]effects?\b", r"\bpooled\b", r"\bnarrative synthesis\b", r"\bheterogeneity\b"], METHODS),
        ("certainty", [r"\bgrade\b", r"\bcertainty of (the )?evidence\b", r"\bquality of (the )?evidence\b"], ANYWHERE),
        ("flow", [r"\brecords?\b[^.]{0,40}\b(identified|screened|retrieved)\b", r"\bfull[- ]text\b", r"\bflow (diagram|chart)\b", r"\b\d[\d,]*\s+(studies|articles|records|trials)\b"], RESULTS),
        ("results", [*INTERVALS, r"\bi\s?(\^)?2\b", r"\bheterogeneity\b"], RESULTS),
        ("limitations", LIMITS, DISCUSSION),
        ("registration", [r"\bprospero\b", r"\bregist(ered|ration)\b", r"\bprotocol\b"], ANYWHERE),
        ("funding", FUNDING, ANYWHERE),
    ],
    "epiforge": [
        ("design", [r"\bforecast", r"\bnowcast", r"\bprojection", r"\bpredict"], FRONT + INTRO),
        ("purpose", [r"\binform(ing|s)? (the )?(response|decisions?|planning|policy|public health)", r"\bdecision[- ]makers?\b", r"\bpolicymakers\b", r"\bpublic health (response|planning|authorities)\b"], INTRO + METHODS),
        ("target", [r"\b(forecast|predict|project)(ed|s|ing)?\b[^.]{0,60}\b(cases|incidence|peak|deaths|hospitali[sz]ations|admissions|attack rate)\b", r"\btarget\b"], INTRO + METHODS),
        ("horizon", [r"\bhorizons?\b", r"\b(weeks?|days?|months?) ahead\b", r"\b\d+-(week|day|month)[- ]ahead\b"], INTRO + METHODS),
        ("data", [r"\bsurveillance\b", r"\bdata (were|was) (obtained|collected|drawn|downloaded)\b", r"\bpublicly available\b", r"\bregist(er|ry)\b"], METHODS),
        ("data-issues", [r"\breporting (delay|fraction|rate|probability)\b", r"\bunder-?report", r"\bbackfill", r"\bright[- ]truncat", r"\bnowcast", r"\bascertainment\b"], METHODS),
        ("model", [r"\b(seir|sir|seirs|compartmental|renewal|branching process|agent-based|arima|regression|ensemble|machine learning|mechanistic|statistical) (model|approach|equation)"], METHODS),
        ("assumptions", [r"\bassum(e|ed|es|ing|ption)"], METHODS),
        ("parameters", [r"\bparameters?\b", r"\bpriors?\b", r"\bfixed at\b", r"\bcalibrat", r"\bestimated (from|by|using)\b"], METHODS),
        ("uncertainty", [*INTERVALS, r"\bquantiles?\b", r"\bposterior predictive\b", r"\buncertainty\b"], RESULTS + METHODS),
        ("evaluation", [r"\b(mean )?absolute error\b", r"\brmse\b", r"\bmae\b", r"\blog(arithmic)? score\b", r"\bcrps\b", r"\binterval score\b", r"\bcoverage\b", r"\bout-of-sample\b", r"\bheld-out\b", r"\bskill\b", r"\bcalibration of the forecasts?\b"], METHODS + RESULTS),
        ("baseline", [r"\bbaseline\b", r"\bnull model\b", r"\bnaive\b", r"\bpersistence\b", r"\bcompared with (other|an?) (models?|forecasts?)\b"], METHODS + RESULTS),
        ("code", [r"\bcode\b[^.]{0,40}\bavailable\b", r"\bgithub\b", r"\bzenodo\b", r"\brepository\b", r"\bopen[- ]source\b"], ANYWHERE),
        ("limitations", LIMITS, DISCUSSION),
        ("funding", FUNDING, ANYWHERE),
    ],
}
