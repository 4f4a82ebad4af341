"""Views over the given documents for checks whose words the documents never use: every document gets
one of our own short passages appended, chosen by its id.  The oracle computes the same view in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.sources.shared import dealt

SEEDS = [
    "We utilize the new scheme in order to reach the end result.",
    "Due to the fact that rates fell, it should be noted that each and every site was very quiet.",
    "This is a novel variant of the novel method, and it's groundbreaking.",
    "Abstract\nThe results will be discussed later. We found that rates fell by 12%.",
    "Results\nFigure 1 shows the rates. This clearly proves the point. The change was significant.",
    "Methods\nWe fitted a model. The slope was statistically significant and significantly lower.",
    "Discussion\nThis definitively proves the claim by induction. Of course, it is clear that rates fell. Obviously, they rose.",
    "There are many studies of this kind. It was clear that rates fell. Much research has been done.",
    "However, rates fell. They rose again. Nevertheless, they fell. Yet, nobody knows.",
    "The drug may possibly help. It could not possibly fail. It suggests that it may work.",
    "The behaviour was odd, the behavior was new, and the behaviour was kept. The colour and the color.",
    "The data set was small. The dataset was kept, and the dataset was read. The data-set was old.",
    "We took 5 mg and 6 mg and 7mg of it. We took 5km and 6 km.",
    "12 patients were seen at the same clinic twice. 2020 was a year of no note at all here.",
    "The mean absolute error (MAE) was low. The mean absolute error (MAE) was high. MAE and MAE again.",
    "The ABXQ was used. The (QXB) was not. The Generic Linear Unit (GLU) was used once. XTQ lines rose.",
    "Measles is known to be common. It is considered to be rare [12]. It is widely believed to be new.",
    "This has never been studied. To our knowledge, this has not been studied. No previous work exists here.",
    "The rates rose sharply, according to our own runs. They fell, as shown in the plot.",
    "In terms of cost, prior to the start, a majority of sites paid. The rate is relatively low.",
    "This sheds light on the matter and paves the way for more. We conducted a careful analysis of rates.",
    "One two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen. This suggests a change. This finding holds.",
    "Introduction\nInfluenza is a major burden worldwide. Little is known about its spread. We therefore aim to test this.",
    "Conclusion\nThis leads to higher costs because demand rises. We argue that this must be seen. Future research should follow.",
    "Limitations\nOur sample has limitations. We conclude that the effect reduces risk. It results in harm.",
    "The estimation, the evaluation and the calculation of the comparison failed. Needless to say, we stopped.",
    "Results\nWe observed a decline. Table 2 presents the counts. It was associated with age. Thus, risk fell.",
    "The item was reviewed by Miller. The item was reviewed by hand. You don't say, and we can't tell.",
    "Introduction\n" + "The spread of the fever was followed in the town for a number of weeks, and the cases were listed by street and by day. " * 6,
    "Abstract\n" + "The cases were listed by street and by day in the order in which they came in. " * 5,
    "References\nA very novel scheme. We utilize the scheme.\nConclusion\nThe NEW TOWN REVIEW was read. It can cause harm. It caused harm and reduced the risk. Financial leverage rose.",
    "The lemma proves the claim. The trial proves the claim. We leverage the data.",
]
TEX_SEEDS = [
    "\\begin{figure}\\includegraphics{a}\\caption{Rates by age group in each of the years}\\label{fig:a}\\end{figure} See Figure \\ref{a}.",
    "\\begin{figure}\\caption{Rates}\\label{fig:b}\\end{figure} Nobody cites it.",
    "See \\ref{fig:none}. \\begin{table}\\caption{Counts by site}\\label{tab:c}\\end{table} See Table 1 and Table 3.",
    "Rates fell. \\begin{equation} x = y \\label{eq:x} \\end{equation} Then, as in \\eqref{eq:x}, they rose and",
    "It holds that \\begin{equation} a = b \\label{eq:y} \\end{equation} for all.",
    "See Figure 2, then Figure 1. \\begin{figure}\\caption{One thing and another thing}\\end{figure} \\begin{figure}\\caption{Two things}\\end{figure}",
    "\\section{Results} \\subsection{Model fit} It fits. \\section{A model of spread} \\subsection{Limitations} None.",
]
#: Passages of five kinds of study, and of none.
STUDY_SEEDS = [
    "Abstract\nWe ran a cohort study of fever. The objective was to estimate the risk.\nMethods\nCases of 2019 were kept. Children aged 10 were recruited. The outcome was defined as fever. It was measured by questionnaire. The regression was adjusted for age.\nResults\nThe mean age was 40. The odds ratio was 2 (95% CI 1 to 3).\nDiscussion\nBias cannot be ruled out. The work was supported by a grant.",
    "Abstract\nIn this randomised controlled trial, we aimed to test a drug.\nMethods\nPatients were randomly assigned in parallel groups. The control arm received placebo. The primary outcome was fever. A computer-generated list was kept in sealed opaque envelopes. Staff were masked. Groups were compared.\nResults\n120 patients were allocated. No adverse events were seen.\nConclusion\nThe protocol was registered. The trial has limitations.",
    "This systematic review follows a protocol. Two reviewers screened titles and abstracts independently. PubMed was searched. A random-effects model pooled the data. Heterogeneity was high. It was funded by the town.",
    "Abstract\nWe forecast cases two weeks ahead to inform the response.\nMethods\nA renewal model was fitted to surveillance data. We assume a reporting delay. Priors were wide. Coverage was compared with a naive baseline.\nResults\nPrediction intervals were wide.\nDiscussion\nThe code is available on request.",
    "Limitations\nThis meta-analysis of an observational study was small.\nMethods\nIt is shown below.",
    "The town was quiet for a year.",
]
#: Passages that quote numbers from tables, and cite ranges of floats.
TABLE_SEEDS = [
    "\\begin{table}\\caption{Rates by site}\\label{tab:r}a & 12.5 & 0.4321 & 30\\% \\end{table} Table 1 shows a rate of 12.5 a year and 0.43 in all. In Table 1 the share was 31\\% at p < 0.05 and 14.25 elsewhere. Table 1 adds up to 99.9 overall.",
    "\\begin{table}\\caption{Counts}\\label{tab:c}a & 1,250 & 7 \\end{table} As in \\ref{c}, the share was 4.5\\% of 1,250 and 7 sites. Table 2 has 9.9 of it.",
    "\\begin{table}\\caption{Odds}\\label{tab:o}a & 1.25 & 2.50 \\end{table} \\begin{figure}\\caption{A curve of it}\\label{fig:o}\\end{figure} The odds were 1.3 with 95\\% CI 1.1 to 9.7 (Table 1). Table 1 and Figure 1 show 7.7 a day. The odds were 2.5 and 3.5 in Table \\ref{tab:o}, not 1,000.5 of them.",
    "\\begin{figure}\\caption{One of four}\\label{fig:1}\\end{figure} \\begin{figure}\\caption{Two of four}\\label{fig:2}\\end{figure} \\begin{figure}\\caption{Three of four}\\label{fig:3}\\end{figure} \\begin{figure}\\caption{Four of four}\\label{fig:4}\\end{figure} See Figures~\\ref{fig:1}--\\ref{fig:4}, and \\ref{fig:1} and \\ref{fig:3}, or \\ref{fig:2} to \\ref{fig:none}.",
    "No table is cited here, and 5.5\\% is no quotation.",
]
#: Ends of word-processor documents: (kind, style, text) by paragraph.
WORD_SEEDS = [
    [("body", "normal", "The rates are in Table 1 and Figure 2."), ("body", "caption", "Table 1. Rates by site"), ("table", "", "a\t1\nb\t2"), ("body", "caption", "Figure 2. A curve of rates"), ("body", "normal", "As Figure 2 shows, they fell.")],
    [("body", "caption", "Table 1. Counts by street"), ("table", "", "a\t3"), ("body", "normal", "The counts are in Table 1, and those of Tables 2-4 are not."), ("table", "", "c\t4"), ("body", "caption", "Table 2. Counts by day"), ("body", "normal", "See Fig. 1.")],
    [("body", "heading1", "Methods We listed the cases by street and by day in the order in which they came in and wrote down the age and the name of each of them twice"), ("body", "heading2", "Results"), ("body", "title", "A study of rates"), ("body", "heading1", "Appendix A"), ("body", "caption", "Table 1. More counts"), ("table", "", "x"), ("body", "normal", "Table 1 is late.")],
    [("body", "toc1", "Table 1. Counts ..... 3"), ("body", "normal", "Table 1: Counts by age"), ("table", "", "a\t5"), ("body", "normal", "Table 1: Counts by age again"), ("table", "", "b\t6"), ("body", "caption", "Table 1 (continued)"), ("body", "caption", "Table 3. Last"), ("body", "normal", "Table 3 is last.")],
    [("table", "", "q"), ("table", "", "r"), ("body", "caption", "Table 1. Above it"), ("body", "caption", "Table 2. None left"), ("body", "normal", "Tables 1 and 2 are known.")],
]
#: Passages that name equations and labels.
EQUATION_SEEDS = [
    "By Eqs. (1)-(3) it holds \\label{eq:a}, see \\eqref{eq:a} and \\ref{eq:none}.",
    "See Equation 2 and Equations 4 to 6, not Eq. 9-1. \\label{b} \\label{c}",
    "See Eq. (5) and Eqs. 1-80. No label is given here.",
]
#: Papers whose sections make all of their moves, some, none, or in another order.
NARRATIVE_SEEDS = [
    "Abstract\nFever is a major burden in the town. However, its spread remains unclear. We therefore aimed to estimate it. We fitted a model to counts of cases by street and by day. We found that rates fell by 12% in a year. These findings suggest that future research should follow the cases by street and by day, and in other towns as well as in this one.\nIntroduction\nFever affects 3 million people each year. Little is known about its spread. The present study aims to test it.\nMethods\nWeekly data were collected by street. A renewal model was fitted by maximum likelihood.\nResults\nWe observed a fall. It was 12% in Table 1.\nDiscussion\nIn this study we found that rates fell. This suggests that the streets differ, because they were cleaned. It is consistent with previous work. The sample was small, which is a limitation. It could be used to plan visits.\nConclusion\nThis work provides a map of the town. Policymakers should see it.",
    "Introduction\nWe therefore aim to test the rule. Its use remains unknown. Fever is an important illness worldwide.\nDiscussion\nNothing is told here. It was dry.\nLimitations\nThe days were few.\nAppendix A\nMore lines of it.",
    "Abstract\nWe surveyed the streets and the days of the town, using data from the parish. The cases were listed in the order in which they came in, street by street and day by day, by the clerk of the town and by his two sons. The lists were kept in a box in the hall of the town, where all of them could be read by anyone who asked for them there.\nResults\nThe lists were long.",
    "Introduction\nThe fever has not been counted here, yet it is common and rarely seen. Fever is a leading cause of death. We asked why it is so.\nMethods\nThe lists were read twice.\nConclusion\nThe lists end here. The next season will tell.",
    "Abstract\nThe results show a fall of 5%. Here we ask why. Although the fall is known, its cause is overlooked. The cause matters to us all and to the town in which we live, as it does to any other town of this size with as many streets, as many wells and as many days of rain in a year, and so it was looked for in the lists of the parish with some care\nConclusion\nIt is a novel list, and the authors provide it.\nReferences\nMiller et al. (2019) found that rates fell.",
    "Abstract\nShort.\nIntroduction\nThe gap in our knowledge is what we examine. We examine it now.",
]
#: Passages in which one safe edit brings out another.
POLISH_SEEDS = [
    "It should be noted that there are three things that drive it. We utilize the the scheme in order to reach the end result.",
    "There is a cost that each and every site paid. Due to the fact that rates fell, they had had enough.",
    "There were, in short, no sites.\nThere was one site which paid prior to the start , and left.",
    "Nothing to be mended here.",
]


def _with(spark: SparkSession, sf_dir: str, seeds: list[str]) -> DataFrame:
    docs = dealt(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang", "source", "text"))
    seed = F.element_at(F.array(*map(F.lit, seeds)), (F.col("doc_id") % len(seeds) + 1).cast("int"))
    return docs.select("doc_id", "lang", "source", F.concat("text", F.lit("\n"), seed).alias("text"))


def seeded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _with(spark, sf_dir, SEEDS)


def seeded_tex(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _with(spark, sf_dir, TEX_SEEDS)


def seeded_with(spark: SparkSession, sf_dir: str, seeds: list[str]) -> DataFrame:
    return _with(spark, sf_dir, seeds)


# --- the same in SQL ---


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _view(seeds: list[str]) -> str:
    return f"seeded AS (SELECT doc_id, lang, source, text || chr(10) || ([{', '.join(map(quoted, seeds))}])[(doc_id % {len(seeds)} + 1)::INT] AS text FROM documents)"


SEEDED, SEEDED_TEX, SEEDED_STUDY, SEEDED_POLISH, SEEDED_EQUATIONS, SEEDED_TABLES, SEEDED_NARRATIVE = map(_view, (SEEDS, TEX_SEEDS, STUDY_SEEDS, POLISH_SEEDS, EQUATION_SEEDS, TABLE_SEEDS, NARRATIVE_SEEDS))
#: Other alphabets' letters are letters at word borders, as in the engine's patterns.
PLAIN = "plain AS (SELECT doc_id, text, regexp_replace(text, '[^\\x00-\\x7F]', '0', 'g') AS flat FROM seeded)"


def hits_sql(pattern: str, source: str = "plain", column: str = "flat", name: str = "hits") -> str:
    """CTEs ending in ``name`` (doc_id, i, start, end, text, doc): all matches with their places."""
    p = quoted(pattern)
    return f"""
{name}_parts AS (SELECT doc_id, text AS doc, string_split_regex({column}, {p}) AS g, regexp_extract_all({column}, {p}) AS h FROM {source}),
{name}_steps AS (SELECT doc_id, doc, i, length(g[i]) AS gl, length(h[i]) AS hl FROM {name}_parts, unnest(range(1, len(h) + 1)) AS t(i)),
{name}_places AS (SELECT *, (sum(gl + hl) OVER (PARTITION BY doc_id ORDER BY i))::INT AS e FROM {name}_steps),
{name} AS (SELECT doc_id, i, (e - hl)::INT AS start, e AS "end", substr(doc, (e - hl + 1)::BIGINT, hl::BIGINT) AS text, doc FROM {name}_places)"""


SENTENCES = """
sp AS (SELECT doc_id, string_split_regex(text, '[.!?]\\s+') AS g, regexp_extract_all(text, '[.!?]\\s+') AS h FROM seeded),
st AS (SELECT doc_id, i, g[i] || coalesce(left(h[i], 1), '') AS text, length(g[i]) + coalesce(length(h[i]), 0) AS n FROM sp, unnest(range(1, len(g) + 1)) AS t(i)),
sents AS (SELECT doc_id, (i - 1)::INT AS sent, text, length(text)::INT AS len, regexp_replace(text, '[^\\x00-\\x7F]', 'q', 'g') AS flat,
          coalesce(sum(n) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::INT AS start FROM st)"""
WORDS = "regexp_extract_all({0}, '[A-Za-z0-9\\x{{80}}-\\x{{10FFFF}}]+(?:[''’-][A-Za-z0-9\\x{{80}}-\\x{{10FFFF}}]+)*')"


def words_sql(column: str = "text") -> str:
    return WORDS.format(column)


def listed(values) -> str:
    return "(" + ", ".join(quoted(v) for v in values) + ")"
