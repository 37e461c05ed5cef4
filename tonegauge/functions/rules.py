"""Rule tables: patterns with raw weights, grouped by subcategory in matching order.

Patterns are written in the common dialect (\\b, \\w, \\d for ASCII, \\s for all white
space, $ for the end of the text); ``text.java`` turns them into Java's. They are
case-insensitive unless their rule says otherwise.
"""

from __future__ import annotations

from typing import NamedTuple


class Rule(NamedTuple):
    """ord: position in its table; weights are raw, scales are applied by the scorers."""

    ord: int
    pattern: str
    weight: float
    category: str
    subcategory: str
    case: bool


def _rules(category: str, groups: list) -> list[Rule]:
    """Numbered rules of (subcategory, [(pattern, weight[, "case"])]) groups."""
    found = [(sub, *row) for sub, rows in groups for row in rows]
    return [Rule(i, row[1], row[2], category, row[0], len(row) > 3) for i, row in enumerate(found)]



# Directness patterns and weights.
_DIRECTNESS = [
    ("mood_derivable", [
        (r"^\s*(?:hey\s+@?\w+[,:]?\s*)?(send|share|forward|upload|post|attach|submit|return)\b(?!ing)", 10.0),
        (r"^\s*(?:hey\s+@?\w+[,:]?\s*)?(review|check|confirm|approve|sign|verify|look at|proofread)\b(?!ing)", 10.0),
        (r"^\s*(?:hey\s+@?\w+[,:]?\s*)?(fix|update|add|remove|delete|change|rename|merge|push|deploy|revert|swap|schedule)\b(?!ing)", 10.0),
        (r"^\s*please\s+(?!let me know|feel free|don't hesitate|ignore)\w+\b", 10.0),
        (r"\bgo ahead and\s+\w+", 10.0),
        (r"^\s*(make sure|be sure)\s+(to|you)\b", 10.0),
        (r"^\s*(don'?t|do not|never|stop|hold off on)\s+\w+", 10.0),
        (r"^\s*(get|grab|pull|put|drop|throw|write up|set up|spin up|loop)\s+\w+", 10.0),
        (r"^\s*(action|todo|to-do|ask|next step)s?\s*[:\-—]", 10.0),
        (r"^\s*@\w+\s+(please\s+)?(send|review|fix|update|confirm|check|take)\b", 10.0),
        (r"^\s*(ping|dm|message|call|email)\s+(me|@?\w+)\b", 10.0),
    ]),
    ("performative", [
        (r"\bI'?m asking (you )?to\b", 9.0),
        (r"\bI'?m asking (that|you)\b", 9.0),
        (r"\bI'?m requesting\b", 9.0),
        (r"\bI'?m telling you\b", 9.0),
        (r"\b(this is|consider this) (a|my|an official|a formal) (request|ask)\b", 9.0),
        (r"\bI'?m assigning (this|that|it) to you\b", 9.0),
        (r"\b(I'?m|I am) (formally |hereby )?(asking|requesting|instructing|directing)\b", 9.0),
        (r"\bmy ask (here )?is\b", 9.0),
        (r"\bthe ask (here )?is\b", 9.0),
        (r"\bconsider this (your |a )?(notice|heads[- ]up that you (need|must))\b", 9.0),
    ]),
    ("hedged_performative", [
        (r"\bI'?d like to ask (you )?to\b", 8.0),
        (r"\bI want(ed)? to ask (if|whether|you)\b", 8.0),
        (r"\bcan I ask (you )?to\b", 8.0),
        (r"\bI(?:'?d| would) like to request\b", 8.0),
        (r"\bI(?:'?m| am) going to have to ask (you )?to\b", 8.0),
        (r"\bjust wanted to ask\b", 8.0),
        (r"\bmind if I ask (you )?to\b", 8.0),
        (r"\bI (do )?need to ask (you )?to\b", 8.0),
        (r"\bI'?m hoping (I can|to) ask\b", 8.0),
        (r"\bhave (a|one) ask for you\b", 8.0),
        (r"\bwanted to (flag|raise) (an ask|a request)\b", 8.0),
    ]),
    ("obligation", [
        (r"\byou (need|have) to\b", 7.0),
        (r"\byou'?ll (need|have) to\b", 7.0),
        (r"\byou must\b", 7.0),
        (r"\byou'?re (going to have|gonna have) to\b", 7.0),
        (r"\bI need you to\b", 7.0),
        (r"\bI'?m (going to |gonna )?need you to\b", 7.0),
        (r"\bwe need you to\b", 7.0),
        (r"\bthis (needs|has) to be\b", 7.0),
        (r"\b[A-Za-z][A-Za-z0-9 _-]{0,40} needs (doing|a look)\b", 7.0),
        (r"\b(it|that) needs to (be |get )?\w+", 7.0),
        (r"\byou should\b", 7.0),
        (r"\b(you'?re|you are) expected to\b", 7.0),
        (r"\b(it'?s|this is) (your|on you to)\b", 7.0),
        (r"\brequired (to|that you)\b", 7.0),
    ]),
    ("want", [
        (r"\bI(?:\s+would|'?d)?\s+(?:really\s+)?like\b(?! to ask)", 6.0),
        (r"\bI want\b(?!ed to ask)", 6.0),
        (r"\bI need\b(?! (you|to ask))", 6.0),
        (r"\bwe (need|want)\b(?! you to)", 6.0),
        (r"\bI'?m looking for\b", 6.0),
        (r"\bwhat I (need|want|'?m after) is\b", 6.0),
        (r"\bI'?m hoping (for|to get|we can get)\b", 6.0),
        (r"\bI'?d love (to (get|have|see)|it if)\b", 6.0),
        (r"\bit'?d be (great|helpful|good|useful) to (get|have)\b", 6.0),
        (r"\bwould be (great|good|helpful) if\b", 6.0),
        (r"\bI'?m after\b", 6.0),
        (r"\b(hoping|looking) to get (this|that|it) (back|over|across)\b", 6.0),
    ]),
    ("suggestory", [
        (r"\bhow about\b", 4.5),
        (r"\bwhat if (you|we)\b", 4.5),
        (r"\bwhy don'?t (you|we)\b", 4.5),
        (r"\b(let'?s|lets)\b(?! say| see if)", 4.5),
        (r"\bmaybe (you|we) (could|should|can)\b", 4.5),
        (r"\bwe could\b", 4.5),
        (r"\b(one|another) option (is|would be)\b", 4.5),
        (r"\b(might be|could be) worth\b", 4.5),
        (r"\bshould we\b", 4.5),
        (r"\b(shall|do you want to) (we|jump|hop|sync)\b", 4.5),
        (r"\b(thoughts on|open to) \w+ing\b", 4.5),
        (r"\bcan we (look at|revisit|try)\b", 4.5),
    ]),
    ("query_preparatory", [
        (r"\bcan you\b", 3.5),
        (r"\bcould you\b", 3.5),
        (r"\bwould you\b(?! mind)", 3.5),
        (r"\bwill you\b", 3.5),
        (r"\b(are|were) you able to\b", 3.5),
        (r"\bwould you be able to\b", 3.5),
        (r"\bdo you (have time|have a sec|have bandwidth) to\b", 3.5),
        (r"\bany chance you could\b", 3.5),
        (r"\bwould you mind\b", 3.5),
        (r"\bis it possible to\b", 3.5),
        (r"\bdo you think you could\b", 3.5),
        (r"\bmind (sending|sharing|taking|having|checking|giving)\b", 3.5),
    ]),
    ("strong_hint", [
        (r"\bI (still )?don'?t (have|see)\b", 2.0),
        (r"\bhaven'?t (seen|got|received)\b", 2.0),
        (r"\b(is|'?s) still (missing|empty|blank|outstanding)\b", 2.0),
        (r"\bnothing (came through|in there|yet) (on|for|from)\b", 2.0),
        (r"\bno (sign of|update on|word on)\b", 2.0),
        (r"\b(hasn'?t|didn'?t) (land|come through|show up|arrive)\b", 2.0),
        (r"\bthe (folder|doc|sheet|channel|ticket) (is|'?s) (still )?empty\b", 2.0),
        (r"\bcan'?t find (the|your|any)\b", 2.0),
        (r"\bnot sure (if|whether) (this|that|it) (ever )?(went|got) (out|sent)\b", 2.0),
        (r"\bwe'?re (short|missing) (a|the|one)\b", 2.0),
        (r"\b(don'?t think|not sure) (I|we) (ever )?got\b", 2.0),
    ]),
    ("mild_hint", [
        (r"\b(going to be|'?s going to be|is) tight\b", 1.0),
        (r"\bcutting it (a bit )?(close|fine)\b", 1.0),
        (r"\b(not much|running out of) (time|runway|room)\b", 1.0),
        (r"\bwe'?re (a bit )?behind\b", 1.0),
        (r"\b(clock'?s ticking|down to the wire)\b", 1.0),
        (r"\bit'?s been (a while|a few days|quiet)\b", 1.0),
        (r"\b(this|that) one'?s gone quiet\b", 1.0),
        (r"\b(lot|a lot) to get through before\b", 1.0),
        (r"\bstarting to (worry|get nervous) about\b", 1.0),
        (r"\b(just|only) (two|three|a couple of) days (left|to go)\b", 1.0),
        (r"\bhow'?s (this|that|it) looking\b", 1.0),
    ]),
]


# Downgraders patterns and weights.
_DOWNGRADERS = [
    ("syntactic.interrogative", [
        (r"\?\s*$", 1.0, "case"),
        (r"\b(right|yeah|ok|okay)\?\s*$", 1.2),
    ]),
    ("syntactic.negation", [
        (r"\bI don'?t suppose\b", 2.6),
        (r"\byou (couldn'?t|wouldn'?t) .{0,40}(could|would) you\b", 2.4),
        (r"\bif (it'?s|that'?s) not (too much|a hassle|a pain)\b", 1.8),
        (r"\bI (know|realise|realize) (this is|it'?s) (a lot|short notice|annoying)\b", 1.4),
    ]),
    ("syntactic.past_tense", [
        (r"\bI wanted to\b", 1.6),
        (r"\bI was hoping\b", 2.0),
        (r"\bI was going to ask\b", 2.0),
        (r"\bI was thinking\b", 1.6),
        (r"\bI'?d meant to\b", 1.4),
    ]),
    ("syntactic.embedded_if", [
        (r"\bI was wondering if\b", 2.8),
        (r"\bI wonder if\b", 2.2),
        (r"\bwondering if you (could|might|would)\b", 2.6),
        (r"\bif you could\b", 1.8),
        (r"\bif (you'?re|you are) able to\b", 1.8),
        (r"\bI don'?t know if you'?d (be able|want|have time)\b", 2.8),
    ]),
    ("syntactic.conditional", [
        (r"\bcould\b", 1.0),
        (r"\bwould\b", 1.0),
        (r"\bmight\b", 1.2),
    ]),
    ("syntactic.weak_deontic", [
        (r"\byou should\b", 0.8),
    ]),
    ("politeness_marker", [
        (r"\bplease\b", 0.8),
        (r"\bif you (would|could) be so kind\b", 1.4),
        (r"\b(thanks|thank you) in advance\b", 0.6),
        (r"\bsorry to (bother|bug|ask|chase)\b", 1.6),
        (r"\bapologies for the (chase|nudge|noise)\b", 1.4),
    ]),
    ("consultative", [
        (r"\bdo you think\b", 1.4),
        (r"\bwhat do you (think|reckon)\b", 1.6),
        (r"\bwould it be (ok|okay|alright|possible)\b", 1.6),
        (r"\bdoes that (work|make sense) for you\b", 1.4),
        (r"\bup to you\b", 2.6),
        (r"\btotally up to you\b", 3.0),
        (r"\byour call\b", 2.6),
        (r"\bhappy either way\b", 2.4),
        (r"\bfeel free to (ignore|say no|push back)\b", 3.0),
        (r"\bno (worries|problem) if not\b", 2.6),
    ]),
    ("workplace_formula", [
        (r"\bno rush\b", 2.0),
        (r"\bno (pressure|stress)\b", 2.6),
        (r"\bdon'?t stress\b", 2.4),
        (r"\bwhenever you (get|have) (a chance|a sec|time)\b", 2.4),
        (r"\bif you (get|have) a (sec|second|minute|moment)\b", 2.2),
        (r"\bwhenever (works|suits|is good)\b", 2.2),
        (r"\bonly if you have time\b", 2.8),
        (r"\bif (you'?ve|you have) got (a|the) (sec|time|bandwidth)\b", 2.2),
        (r"\bjust a (thought|idea|suggestion)\b", 2.4),
        (r"\bgentle(?=\s+(nudge|reminder|bump))\b", 1.0),
        (r"\bnot a big deal\b", 2.2),
        (r"\b(low|no) priority\b", 2.2),
        (r"\bnot urgent\b", 2.2),
        (r"\bwhen you can\b", 2.0),
        (r"\bat your convenience\b", 2.0),
        (r"\bat your earliest convenience\b", 1.8),
        (r"\bwhen you'?re (back|around|free)\b", 1.8),
        (r"\bwhenever it makes sense\b", 2.0),
        (r"\bI mean it\b", 1.2),
        (r"\bno guilt( at all)?\b", 1.8),
    ]),
    ("understater", [
        (r"\ba (bit|little|touch)\b", 1.0),
        (r"\b(quick|quickly|super quick)\b", 1.2),
        (r"\b(small|minor|tiny|little) (thing|ask|favou?r|change|tweak)\b", 1.4),
        (r"\bbriefly\b", 1.0),
        (r"\bjust a (couple|few) of?\b", 1.2),
        (r"\b(two|five) minutes?\b", 1.2),
        (r"\bnothing (major|serious|urgent)\b", 1.6),
    ]),
    ("hedge", [
        (r"\b(sort of|kind of|kinda|sorta)\b", 1.0),
        (r"\bsomehow\b", 0.8),
        (r"\bor something\b", 1.2),
        (r"\bmore or less\b", 0.8),
        (r"\b(roughly|ballpark)\b", 0.8),
        (r"\bwhatever (works|you think)\b", 1.8),
    ]),
    ("subjectivizer", [
        (r"\bI think\b", 1.2),
        (r"\bI feel like\b", 1.4),
        (r"\bI'?m not sure (but|if)\b", 1.8),
        (r"\bI (guess|suppose)\b", 1.6),
        (r"\bin my (view|opinion)\b", 1.0),
        (r"\bit (feels|seems) like\b", 1.2),
        (r"\bmy (sense|instinct) is\b", 1.2),
    ]),
    ("downtoner", [
        (r"\bjust\b", 1.2),
        (r"\bmaybe\b", 1.2),
        (r"\b(possibly|perhaps)\b", 1.0),
        (r"\bany chance\b", 1.6),
        (r"\bat all\b", 1.0),
        (r"\bby any chance\b", 1.6),
        (r"\bif possible\b", 1.6),
        (r"\bideally\b", 1.4),
        (r"\bpotentially\b", 1.0),
    ]),
    ("cajoler", [
        (r"\byou know\b", 0.5),
        (r"\bI mean\b", 0.5),
    ]),
    ("appealer", [
        (r"\bif that (works|makes sense|is ok)\b", 1.8),
        (r"\bhope that'?s (ok|alright|fine)\b", 1.8),
        (r"\blet me know if (that'?s|it'?s) (a problem|not doable|tricky)\b", 2.0),
    ]),
]


# Upgraders patterns and weights.
_UPGRADERS = [
    ("intensifier", [
        (r"\breally\b", 1.0),
        (r"\bvery\b", 0.8),
        (r"\babsolutely\b", 1.6),
        (r"\bcompletely\b", 1.2),
        (r"\breally really\b", 1.8),
        (r"\bso (much|badly)\b", 1.0),
        (r"\bat all costs\b", 2.2),
        (r"\bwhatever it takes\b", 2.0),
    ]),
    ("commitment", [
        (r"\bobviously\b", 1.4),
        (r"\bclearly\b", 1.2),
        (r"\bdefinitely\b", 1.2),
        (r"\bwithout (question|a doubt)\b", 1.4),
        (r"\bthere'?s no (way|question|option)\b", 1.8),
        (r"\bneeds? to happen\b", 1.6),
        (r"\bnon[- ]negotiable\b", 2.4),
    ]),
    ("lexical_uptoner", [
        (r"\bcritical\b", 2.0),
        (r"\burgent(ly)?\b", 2.0),
        (r"\b(top|high|highest) priority\b", 1.8),
        (r"\bessential\b", 1.6),
        (r"\b(huge|massive|enormous)\b", 1.2),
        (r"\bserious(ly)?\b", 1.4),
        (r"\bbig deal\b", 1.4),
        (r"\breally important\b", 1.6),
        (r"\bmust[- ]have\b", 1.8),
    ]),
    ("emphatic_orthography", [
        (r"\b[A-Z]{3,}\b", 1.2, "case"),
        (r"!{2,}", 1.6, "case"),
    ]),
    ("repetition", [
        (r"\b(\w+)\s+\1\b", 0.8),
    ]),
]


# Temporal patterns and weights.
_TEMPORAL = [
    ("none.explicit", [
        (r"\bno (hard |fixed |firm )?(deadline|date)\b", 0.0),
        (r"\bopen[- ]ended\b", 0.0),
        (r"\bnot time[- ]sensitive\b", 0.0),
        (r"\bno timeline (on this|yet)\b", 0.0),
        (r"\bbacklog(ged)?\b", 0.0),
        (r"\bnice to have\b", 0.0),
    ]),
    ("vague", [
        (r"\bsometime\b", 0.5),
        (r"\bat some point\b", 0.5),
        (r"\beventually\b", 0.5),
        (r"\bdown the (line|road|track)\b", 0.5),
        (r"\bin due course\b", 0.5),
        (r"\bbefore (too|much) long\b", 0.5),
        (r"\bin the (near|nearish) (future|term)\b", 0.5),
        (r"\bat some stage\b", 0.5),
        (r"\bafter the (dust settles|crunch|launch madness)\b", 0.5),
        (r"\bat some point (this|next) (month|quarter)\b", 0.5),
    ]),
    ("relative", [
        (r"\bthis week\b", 1.5),
        (r"\bnext week\b", 1.5),
        (r"\bsoon\b", 1.5),
        (r"\bshortly\b", 1.5),
        (r"\bin the next (few|couple of) (days|hours)\b", 1.5),
        (r"\bwithin (?:the next )?(\d+|a few|two|three) (days|hours|weeks)\b", 1.5),
        (r"\bby the end of (the )?(week|sprint|month)\b", 1.5),
        (r"\bthis sprint\b", 1.5),
        (r"\bbefore (the )?(standup|retro|sync|review|demo)\b", 1.5),
        (r"\bahead of (the )?(meeting|call|session)\b", 1.5),
        (r"\bin the next day or (two|so)\b", 1.5),
        (r"\bover the next (day|couple of days)\b", 1.5),
        (r"\bthis (morning|afternoon|evening)\b", 1.5),
        (r"\bbefore (the )?weekend\b", 1.5),
        (r"\bearly next week\b", 1.5),
        (r"\bin a (couple|few) of hours\b", 1.5),
    ]),
    ("named_day", [
        (r"\bby (mon|tues|wednes|thurs|fri|satur|sun)day\b", 3.0),
        (r"\bon (mon|tues|wednes|thurs|fri|satur|sun)day\b", 3.0),
        (r"\b(mon|tues|wednes|thurs|fri)day (at the latest|latest)\b", 3.0),
        (r"\bend of (the )?week\b", 3.0),
        (r"\bEOW\b", 3.0, "case"),
        (r"\btomorrow\b", 3.0),
        (r"\bday after tomorrow\b", 3.0),
        (r"\bby the (\d{1,2})(st|nd|rd|th)\b", 3.0),
        (r"\bon the (\d{1,2})(st|nd|rd|th)\b", 3.0),
        (r"\bmonday morning\b", 3.0),
        (r"\bbefore (mon|tues|wednes|thurs|fri)day\b", 3.0),
        (r"\bby (next|this) (mon|tues|wednes|thurs|fri)day\b", 3.0),
        (r"\b(this|next) (monday|tuesday|wednesday|thursday|friday)\b", 3.0),
        (r"\bend of (the )?(month|quarter)\b", 3.0),
        (r"\bdeadline is (mon|tues|wednes|thurs|fri)day\b", 3.0),
    ]),
    ("date_time", [
        (r"\b(?:mon|tues|wednes|thurs|fri|satur|sun)day (?:EOD|COB)\b", 4.0),
        (r"\b(mon|tues|wednes|thurs|fri|satur|sun)day at \d{1,2}(:\d{2})?\s?(am|pm)?\b", 4.0),
        (r"\bby \d{1,2}(:\d{2})?\s?(am|pm)\b", 4.0),
        (r"\bat \d{1,2}(:\d{2})?\s?(am|pm)\b", 4.0),
        (r"\bby the \d{1,2}(st|nd|rd|th) of \w+\b", 4.0),
        (r"\b\d{1,2}/\d{1,2}(/\d{2,4})?\b", 4.0, "case"),
        (r"\b\d{4}-\d{2}-\d{2}\b", 4.0, "case"),
        (r"\b(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]* \d{1,2}\b", 4.0),
        (r"\bbefore \d{1,2}\s?(am|pm)\b", 4.0),
        (r"\bno later than \d{1,2}(:\d{2})?\s?(am|pm)?\b", 4.0),
        (r"\bdue (on|by) \w+ \d{1,2}\b", 4.0),
        (r"\b\d{1,2}(:\d{2})?\s?(am|pm) (on )?(mon|tues|wednes|thurs|fri)day\b", 4.0),
        (r"\bstart of (play|business) (mon|tues|wednes|thurs|fri)day\b", 4.0),
        (r"\bby (\d{1,2})(st|nd|rd|th) close\b", 4.0),
        (r"\b(before|by) the \d{1,2}(am|pm) (cutoff|cut[- ]off)\b", 4.0),
        (r"\b\d{1,2}(:\d{2})?\s?(am|pm) (sharp|latest)\b", 4.0),
        (r"\bcalendar invite for \w+ \d{1,2}\b", 4.0),
    ]),
    ("immediate", [
        (r"\b(?:within|in) (?:[1-9]|[1-5]\d) minutes?\b", 5.0),
        (r"\bASAP\b", 5.0),
        (r"\bby noon\b", 5.0),
        (r"\bnow\b", 5.0),
        (r"\bright (now|away)\b", 5.0),
        (r"\bimmediately\b", 5.0),
        (r"\bfirst thing (tomorrow|monday|in the morning)\b", 5.0),
        (r"\bin the next (hour|30 minutes|half hour)\b", 5.0),
        (r"\bbefore you (log off|finish|clock out|head out)\b", 5.0),
        (r"\bwithin the hour\b", 5.0),
    ]),
    ("already_past", [
        (r"\bneeded (yesterday|an hour ago)\b", 5.0),
        (r"\b(was|were) due (yesterday|(?:mon|tues|wednes|thurs|fri|satur|sun)day)\b", 5.0),
        (r"\bdue yesterday\b", 5.0),
        (r"\balready overdue\b", 5.0),
        (r"\boverdue since\s+((?:mon|tues|wednes|thurs|fri|satur|sun)day|\w+\s+\d{1,2})\b", 5.0),
        (r"\bwas supposed to be (in|done|sent|submitted) (yesterday|(?:mon|tues|wednes|thurs|fri|satur|sun)day)\b", 5.0),
    ]),
]


# Consequence patterns and weights.
_CONSEQUENCE = [
    ("conditional.explicit_negative", [
        (r"\bif (we|I|you) don'?t .{0,60}(we'?ll|it'?ll|they'?ll|we will|we'?re going to)\b", 3.0),
        (r"\bunless .{0,60}(we'?ll|we can'?t|it won'?t|they'?ll)\b", 3.0),
    ]),
    ("conditional.generic", [
        (r"\botherwise\b", 2.0),
    ]),
    ("conditional.explicit_negative", [
        (r"\bor (else|we'?re|we'?ll have to)\b", 2.4),
        (r"\bif (this|that|it) (slips|doesn'?t land|isn'?t (in|done))\b", 2.8),
        (r"\bif we miss (this|that|the)\b", 3.0),
    ]),
    ("conditional.named_downstream", [
        (r"\bwhich means (we|they|I) (can'?t|won'?t|have to)\b", 2.6),
        (r"\bthat (would|will) (mean|put us|leave us)\b", 2.4),
    ]),
    ("conditional.generic", [
        (r"\bthe risk is\b", 2.2),
        (r"\bworst case\b", 2.0),
    ]),
    ("conditional.explicit_negative", [
        (r"\bif (it|this) doesn'?t (happen|go out|get done)\b", 2.8),
    ]),
    ("conditional.named_downstream", [
        (r"\bcan'?t (move|proceed|go) forward (until|without)\b", 2.8),
    ]),
    ("sanction", [
        (r"\bescalat(e|ing|ed|ion)\b", 3.0),
        (r"\bon hold\b", 2.2),
        (r"\bcan(?:not|'?t) process\b", 2.4),
        (r"\bwon'?t be able to\b", 2.2),
        (r"\bfinal notice\b", 3.0),
        (r"\bloop(ing)? in\b", 2.6),
        (r"\bflag(ging)? (this )?to\b", 2.8),
        (r"\bat risk\b", 2.4),
        (r"\bmiss the (window|deadline|cutoff|slot)\b", 2.8),
        (r"\bslip(ping|s)? (the|to next)\b", 2.4),
        (r"\bbreach(ing)? (the )?(SLA|contract|terms)\b", 3.0),
        (r"\bgo(es|ing)? to (legal|compliance|the board)\b", 3.0),
        (r"\bpull (the|this) (release|launch|feature)\b", 2.8),
        (r"\breopen(ing)? (the )?(ticket|issue)\b", 1.6),
        (r"\bstart (the )?(clock|SLA) (on|again)\b", 2.2),
    ]),
]


# Dependency patterns and weights.
_DEPENDENCY = [
    ("framing", [
        (r"\bwaiting on\b", 2.0),
        (r"\bblocked on\b", 2.2),
        (r"\bblocked (until|without)\b", 2.2),
        (r"\bblocker\b", 2.2),
        (r"\b(is|are|it'?s) blocking\b", 2.2),
        (r"\bbefore (we|I|they) can\b", 2.2),
        (r"\bso (that )?(we|I|they) can\b", 1.8),
        (r"\bholding up\b", 2.2),
        (r"\bdependent on (this|your|you)\b", 2.0),
        (r"\bcan(?:not|'?t) (start|move|finish) (until|without)\b", 2.2),
        (r"\bgating\b", 2.2),
        (r"\bthe last (piece|thing) (we'?re|I'?m) missing\b", 2.0),
        (r"\bcritical path\b", 2.2),
        (r"\beverything else is (ready|done|in)\b", 1.8),
        (r"\bstuck (on|without)\b", 2.0),
    ]),
    ("follow_up", [
        (r"\bfollowing up\b", 1.8),
        (r"\bcircling back\b", 1.8),
        (r"\bbumping this\b", 2.0),
        (r"\bany update\b", 1.8),
        (r"\bchecking in (again|on this)\b", 2.0),
        (r"\bresurface\b", 1.8),
        (r"\b(nudge|reminder|bump)\b", 1.6),
        (r"\bas (mentioned|discussed|per my last)\b", 2.0),
        (r"\bstill (chasing|waiting)\b", 2.2),
        (r"\breminder (that|to)\b", 1.6),
        (r"\bpinging again\b", 2.0),
        (r"\bthird time\b", 2.4),
    ]),
    ("accountability", [
        (r"\bthe client is (asking|waiting|chasing)\b", 2.2),
        (r"\b(leadership|the exec team|the board) (wants|is asking|needs)\b", 2.2),
        (r"\bI told them\b", 2.2),
        (r"\bI'?ve (got|got someone) (waiting|asking)\b", 1.8),
        (r"\bI committed to\b", 2.2),
        (r"\b(promised|said) (it|we'?d|this would) (be|land|go out)\b", 2.2),
        (r"\b@?\w+ is (asking|waiting|expecting)\b", 2.2),
        (r"\b(finance|legal|security|compliance) (needs|is asking for|requires)\b", 2.2),
        (r"\bit'?s on the (board|exec|leadership) (report|deck|update)\b", 2.2),
        (r"\bmy (manager|boss|lead) (is asking|wants|flagged)\b", 2.2),
        (r"\bthey'?re asking me (for|about)\b", 1.8),
        (r"\bI'?m the one who has to\b", 1.8),
    ]),
]


# Levels, rungs, scales, caps and cut points.
LEVELS = ["mood_derivable", "performative", "hedged_performative", "obligation", "want", "suggestory", "query_preparatory", "strong_hint", "mild_hint"]
TOP_LEVEL = 7
RUNG_OF_WEIGHT = {0.0: "none", 0.5: "vague", 1.5: "relative", 3.0: "named_day", 4.0: "date_time", 5.0: "immediate"}
SCALE = {"directness": 1.0, "downgrader": -0.4, "upgrader": 0.4, "temporal": 0.6, "consequence": 0.83, "dependency": 0.8}
MODIFIER_CLAMP, SCORE_MIN, SCORE_MAX, FORCE_BASELINE, EPSILON = 3.0, 0.0, 10.0, 3.0, 1e-9
PROXIMITY_MAX, PROXIMITY_TAU, PROXIMITY_HORIZON = 1.5, 48.0, 336.0
FOLLOW_UP_CAP, ESCALATION_CAP, RESTATED, ACCELERATING, UNANSWERED = 1.6, 3.0, (1.0, 1.8, 2.5), 0.5, 0.5
SAME_REQUEST = 0.3
COMPLETION = ["done", "sent", "shipped", "merged", "attached", "it's in"]
CAPS_EXCLUDED = ["EOD", "COB", "PR", "QA", "API", "ASAP", "NOW", "IMMEDIATELY", "BLOCKING", "BLOCKER", "BLOCKED", "HOLDING"]
CAPS_EXCLUDED_PHRASES = [("RIGHT", "AWAY"), ("FIRST", "THING")]
HARMLESS = "and but so also you your i we us our me my"
ABBREVIATIONS = "mr mrs ms dr prof sr jr st vs etc e.g i.e approx inc ltd co corp no dept jan feb mar apr jun jul aug sep sept oct nov dec"
ACTION_VERBS, IRREGULAR_VERBS = "review send submit update fix confirm share upload attach", {"sent": "send"}
#: Directness patterns that leave these modifier subcategories inside them unabsorbed.
ABSORPTION_EXCEPTIONS = {
    r"\bcould you\b": ["syntactic.conditional"],
    r"\bmaybe (you|we) (could|should|can)\b": ["downtoner"],
    r"\bdo you think you could\b": ["consultative", "syntactic.conditional"],
    r"\bjust wanted to ask\b": ["downtoner"],
}
NEVER_ABSORBED = "syntactic.weak_deontic"
STOPWORDS = """
i you we they he she it me us them your my our their his her its d s m ll re ve t
could would should can will might may must do does did done is are was were am be been being have has had
the a an to of for in on at by with and or but if that this these those so not
please just maybe really very also possibly perhaps kind sort kinda sorta ideally potentially totally actually
let lets asking need needs needed want wants wanted like liked mind think thinks thought possible able chance sec second
minute moment hey thanks thank sorry sure ok okay again
"""

DIRECTNESS = _rules("directness", _DIRECTNESS)
DOWNGRADERS = _rules("downgrader", _DOWNGRADERS)
UPGRADERS = _rules("upgrader", _UPGRADERS)
TEMPORAL = _rules("temporal", _TEMPORAL)
CONSEQUENCE = _rules("consequence", _CONSEQUENCE)
DEPENDENCY = _rules("dependency", _DEPENDENCY)
FOLLOW_UP = [r for r in DEPENDENCY if r.subcategory == "follow_up"]
TABLES = {"directness": DIRECTNESS, "downgraders": DOWNGRADERS, "upgraders": UPGRADERS, "temporal": TEMPORAL, "consequence": CONSEQUENCE, "dependency": DEPENDENCY}


def level_of(rule: Rule) -> int:
    return LEVELS.index(rule.subcategory) + 1


def action_forms() -> dict[str, str]:
    """Every regular inflection of the action verbs, with its base."""
    forms = dict(IRREGULAR_VERBS)
    for base in ACTION_VERBS.split():
        stems = [base] + ([base[:-1]] if base.endswith("e") else []) + ([base + base[-1]] if base[-1] not in "aeiou" else [])
        for stem in stems:
            for ending in ("ing", "ed"):
                forms.setdefault(stem + ending, base)
        for ending in ("es", "s"):
            forms.setdefault(base + ending, base)
    return {f: b for f, b in forms.items() if f not in ACTION_VERBS.split()}
