"""The detection rules: one relation that checker and study both read."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkspan.functions.textfn import dialect


@dataclass(frozen=True)
class Rule:
    id: str
    label: str
    sev: int
    pattern: str
    any_case: bool = True
    start: str = ""  # for Java: what holds wherever a match begins, quicker to see than that no alternative of the pattern fits
    need: str = ""  # for Java: what every match holds, quicker to look for in a text than the pattern

    def java(self, plain: bool = False) -> str:
        body = dialect(self.pattern, True, plain)
        return ("(?i)" if self.any_case else "") + (f"(?={dialect(self.start, True, plain)})(?:{body})" if self.start else body)

    def java_need(self, plain: bool = False) -> str:
        return ("(?i)" if self.any_case else "") + dialect(self.need, True, plain)

    def re2(self) -> str:
        return ("(?i)" if self.any_case else "") + dialect(self.pattern, False)


def _word(chars: str) -> str:
    """One of these at the start of a word."""
    return rf"[{chars}](?<!\w[{chars}])"


# Ids, labels, severities and patterns of the rules, in their order.
RULES = [
    Rule("negative_parallelism", "Negative parallelism", 1, r"\b(?:it|this|that|she|he|[A-Z][a-z]+)?(?:'s|\s+is|\s+was)?\s*n[o']t\s+(?:just|only|merely|simply|about)\s+[^.!?;]{2,60}?[,;—-]+\s*(?:it'?s?|this is|but|that'?s?)\b|\bisn'?t\s+(?:just|only|about)\b", start=r"\b[A-Za-z]*+(?:'|\s++(?:is|was|n)|(?<=no?t)\s)", need=r"n[o']?t\s+(?:just|only|merely|simply|about)"),
    Rule("stock_openers", "Stock opener", 3, r"\bin today'?s\s+(?:fast-paced|digital|ever-(?:changing|evolving)|modern|competitive)[^.!?,]{0,40}\b|\bin the ever-evolving\b|\blet'?s\s+(?:dive|delve|unpack)\b|\bhere'?s the kicker\b", start=_word("ilh")),
    Rule("slop_words", "AI-favorite word", 1, r"\b(?:delve[sd]?|delving|tapestry|multifaceted|meticulous(?:ly)?|underscor(?:e|es|ing)|showcas(?:e|es|ing)|intricate|intricacies|pivotal|holistic|myriad|plethora|seamless(?:ly)?|transformative|groundbreaking|game-chang(?:er|ing)|paradigm shift|unprecedented|cutting-edge|ever-evolving|synerg(?:y|ies|istic)|leverag(?:e|es|ing)|harness(?:es|ing)?|foster(?:s|ing)?|facilitat(?:e|es|ing)|streamlin(?:e|es|ing)|bolster(?:s|ing)?|elevat(?:e|es|ing)|empower(?:s|ing)?|boasts)\b", start=_word("bcdefghilmpstu")),
    Rule("testament", "Inflated symbolism", 2, r"\b(?:stands?|serves?|is)\s+as\s+a\s+testament\b|\ba testament to\b|\bwatershed moment\b|\b(?:enduring|lasting)\s+legacy\b|\brich cultural heritage\b|\bplays?\s+a\s+(?:crucial|vital|pivotal|significant)\s+role\s+in(?:\s+shaping)?\b", start=_word("aeilprsw")),
    Rule("editorializing", "Editorializing aside", 2, r"\bit(?:'s|\s+is)\s+(?:important|worth|essential|crucial)\s+(?:to\s+(?:note|remember|understand|consider)|noting)\b|\bneedless to say\b|\bno discussion .{0,30}complete without\b", start=_word("in")),
    Rule("vague_attribution", "Vague attribution", 2, r"\b(?:experts?|studies|research(?:ers)?|industry reports?|observers|critics|many)\s+(?:say|says|show|shows|suggest|suggests|argue|agree|have noted|believe)\b", start=_word("ceimors")),
    Rule("trailing_participle", "Trailing '-ing' analysis", 2, r",\s+(?:highlighting|underscoring|emphasizing|reflecting|showcasing|demonstrating|signaling|ensuring|reinforcing|solidifying|cementing)\s+[^.!?]{3,60}[.!?]"),
    Rule("summary_ending", "Summary phrase", 2, r"\b(?:in\s+conclusion|in\s+summary|to\s+summariz(?:e|se)|all\s+in\s+all|at\s+the\s+end\s+of\s+the\s+day)\b|(?:^|\.\s+)(?:overall|ultimately),", start=_word("aiotu") + r"|\."),
    Rule("chatbot_artifact", "Chatbot artifact", 3, r"\bgreat question\b|\byou'?re absolutely right\b|\bi hope this (?:helps|message finds you well)\b|\blet me know if you (?:need|have|want)\b|\bcertainly!\b|\b(?:would you like me to|want me to|shall i)\b[^.!?]{0,70}\?", start=_word("cgilswy")),
    Rule("hedged_balance", "Hedged balance", 1, r"\bwhile\s+(?:challenges|there are|it'?s true)[^.!?]{3,60},|\bboth\s+sides\b|\bstrike[s]?\s+a\s+balance\b|\bwhether you'?re a\b", start=_word("bsw")),
    Rule("rule_of_three", "Possible rule-of-three", 1, r"\b\w+(?:ive|ing|able|ant|ent|ful|ous|al|ed)\s*,\s*\w+(?:ive|ing|able|ant|ent|ful|ous|al|ed)\s*,?\s+and\s+\w+(?:ive|ing|able|ant|ent|ful|ous|al|ed)\b", start=r"\b\w++\s*+,"),
    Rule("bot_scaffolding", "Fake-drama scaffolding", 3, r"\bhere'?s (?:the part|the thing|what) (?:nobody|no one)\b|\bthe uncomfortable truth\b|\blet that sink in\b|\bplot twist\b|\bwhat (?:nobody|no one) tells you\b|\bhere'?s where it gets\b", start=_word("hlptw")),
    Rule("contrastive_negation", "Contrastive negation", 3, r"(?:^|[.!?]\s+)Not\s+[a-z][^.!?]{2,55}[.]|(?:^|[.!?]\s+)Not\s+[a-z][^.!?]{2,80}?,?\s+but\s+[^.!?]{2,110}[.]|,\s+not\s+[a-z][a-z'-]{1,18}(?:\s+[a-z][a-z'-]{1,18}){0,2}\s*[.!?]|\b(?:it|that|this|the\s+\w+|[A-Z][a-z]+)\b[^.!?]{0,40}?\b(?:isn'?t|is not|doesn'?t|does not|wasn'?t|aren'?t)\b[^.!?]{0,55}[.]\s+(?:It|That|This|They)'?s?\b[^.!?]{0,65}[.]", False, start="[A-Z.!?,it]", need=r"(?=[N,idwa])(?:Not\s|,\s+not\s|(?:is|does|was|are)(?:n'?t| not)\b[^.!?]{0,55}[.]\s+(?:It|Th))"),
    Rule("fragment_triplet", "Possible fragment triplet", 1, r"(?:^|[.!?]\s+)[A-Z][A-Za-z'-]*(?:\s+[a-z][A-Za-z'-]*)?\.\s+[A-Z][A-Za-z'-]*(?:\s+[a-z][A-Za-z'-]*)?\.\s+[A-Z][A-Za-z'-]*(?:\s+[a-z][A-Za-z'-]*)?\.", False, start="[A-Z.!?]"),
]
#: Measured but no tell: it fires more often on human writing.
RETIRED = Rule("false_range", "Possible false range", 1, r"\bfrom\s+[a-z][^.,;:]{3,35}\s+to\s+[a-z][^.,;:]{3,35}\b")
EM_DASH_RULE = ("em_dash", "Em dash density", 2)
CADENCE_RULE = ("even_cadence", "Even cadence", 2)


def relation(spark: SparkSession) -> DataFrame:
    """ord, rule_id, label, sev of every tell, the two document-level ones last."""
    rows = [(i, r.id, r.label, r.sev) for i, r in enumerate(RULES)]
    rows += [(len(rows), *EM_DASH_RULE), (len(rows) + 1, *CADENCE_RULE)]
    return spark.createDataFrame(rows, "ord int, rule_id string, label string, sev int")


def needed(rule: Rule, straight: Column, found: Column, none: Column, plain: bool = False) -> Column:
    """``found``, asked only of texts that hold what the rule needs; ``none`` for the others. A null text is asked."""
    return F.when(~straight.rlike(rule.java_need(plain)), none).otherwise(found) if rule.need else found


def count(rule: Rule, straight: Column) -> Column:
    """Matches of a rule in straightened text."""
    return needed(rule, straight, F.regexp_count(straight, F.lit(rule.java())), F.lit(0))
