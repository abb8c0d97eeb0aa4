"""Default prompt texts. The slot names are fixed; the wording is ours and may be replaced."""

VERDICT = """Judge the claim from the evidence alone. Today is {{TODAY}} (UTC).
Reply with one line "Verdict: true", "Verdict: false", "Verdict: mixed" or "Verdict: unclear",
then one line "Explanation:" with two to four sentences that point to the evidence.
Source labels say how reliable an outlet is; they prove nothing by themselves.

Claim:
{{CLAIM}}

Evidence:
{{EVIDENCE}}
"""

BIAS = """Describe in a few sentences how good the evidence behind this verdict is: variety of outlets,
age, region, leaning, and what is missing. Leave the verdict as it is.

Claim:
{{CLAIM}}

Evidence:
{{EVIDENCE}}

Verdict:
{{VERDICT}}
"""

FOLLOWUP = """Answer the question briefly from the evidence and the stored verdict. Say so if the evidence
does not tell.

Claim:
{{CLAIM}}

Evidence:
{{EVIDENCE}}

Verdict:
{{VERDICT}}

Explanation:
{{EXPLANATION}}

Question:
{{FOLLOWUP_QUESTION}}
"""
