"""Terms, aliases, stop words and patterns that results depend on."""

from __future__ import annotations

# Fixed values. They must be these for right results.

SIDE_EFFECTS = [
    "nausea", "vomiting", "diarrhea", "constipation", "dizziness", "drowsiness", "headache", "rash", "itching", "hives", "edema", "swelling",
    "palpitations", "insomnia", "nervousness", "anxiety", "depression", "fatigue", "weight gain", "weight loss", "bleeding", "bruising",
    "hypersensitivity", "drug hypersensitivity", "toxicity", "liver damage", "kidney damage", "hepatotoxicity", "nephrotoxicity", "allergic reaction",
    "anaphylaxis", "photosensitivity", "abdominal discomfort", "appetite loss", "blurred vision", "chest tightness", "dry mouth", "dyspepsia",
    "dyspnea", "elevated liver enzymes", "flatulence", "fluid retention", "flushing", "gastritis", "gastrointestinal bleeding", "hot flashes",
    "hypertension", "hypotension", "increased heart rate", "injection site reaction", "joint pain", "leukopenia", "memory impairment",
    "muscle cramps", "muscle weakness", "myalgia", "neutropenia", "oral ulcers", "orthostatic hypotension", "peripheral edema", "pruritus",
    "renal impairment", "sleep disturbance", "somnolence", "stomatitis", "sweating", "thrombocytopenia", "tinnitus", "upper abdominal pain",
    "urticaria", "vertigo", "xerostomia",
]

SYMPTOMS_NLP = [
    "pain", "back pain", "chest pain", "stomach pain", "migraine", "cramps", "inflammation", "fever", "shortness of breath", "weakness", "numbness",
    "tingling", "paresthesia", "confusion", "congestion", "bloating", "tremor", "hallucination", "pins and needles", "sleeplessness", "alopecia",
    "arthralgia", "cognitive decline", "diplopia", "dysphagia", "dysphonia", "dysuria", "epistaxis", "erythema", "hemoptysis", "hematuria",
    "hyperhidrosis", "hypoglycemia", "jaundice", "lymphadenopathy", "malaise", "myalgia", "pallor", "polyuria", "polydipsia", "ptosis", "purpura",
    "rhinorrhea", "rigidity", "seborrhea", "seizure", "syncope", "tachycardia", "urinary retention", "wheezing", "xerophthalmia",
]

SYMPTOMS = [
    "pain", "back pain", "chest pain", "stomach pain", "migraine", "cramps", "inflammation", "fever", "shortness of breath", "weakness", "numbness",
    "tingling", "paresthesia", "confusion", "congestion", "bloating", "tremor", "hallucination", "pins and needles", "sleeplessness", "alopecia",
    "arthralgia", "cognitive decline", "diplopia", "dysphagia", "dysphonia", "dysuria", "epistaxis", "erythema", "hemoptysis", "hematuria",
    "hyperhidrosis", "hypoglycemia", "jaundice", "lymphadenopathy", "malaise", "pallor", "polyuria", "polydipsia", "ptosis", "purpura", "rhinorrhea",
    "rigidity", "seborrhea", "seizure", "syncope", "tachycardia", "urinary retention", "wheezing", "xerophthalmia",
]

ALIASES = {
    "pins and needles": "paresthesia", "paraesthesia": "paresthesia", "sleeplessness": "insomnia", "drug hypersensitivity": "hypersensitivity",
    "stomach pain or cramps": "stomach pain", "abdominal pain": "stomach pain", "throwing up": "vomiting", "sick to stomach": "nausea",
    "hair loss": "alopecia", "loss of hair": "alopecia", "high blood pressure": "hypertension", "low blood pressure": "hypotension",
    "irregular heartbeat": "palpitations", "shortness of breath": "dyspnea", "difficulty breathing": "dyspnea", "blurry vision": "blurred vision",
    "loss of appetite": "appetite loss", "decreased appetite": "appetite loss", "upset stomach": "dyspepsia", "stomach upset": "dyspepsia",
    "water retention": "fluid retention", "joint aches": "joint pain", "muscle pain": "myalgia", "muscle ache": "myalgia", "skin redness": "erythema",
    "fainting": "syncope", "dry eyes": "xerophthalmia",
}

PREFERRED_TERMS = {
    "nausea and vomiting": "nausea", "nausea/vomiting": "nausea", "gi upset": "dyspepsia", "gi distress": "dyspepsia", "stomach ache": "stomach pain",
    "abdominal pain": "stomach pain", "abdominal cramps": "stomach pain", "loose stools": "diarrhea", "loose bowels": "diarrhea",
    "stomach discomfort": "abdominal discomfort", "indigestion": "dyspepsia", "heartburn": "dyspepsia", "reflux": "dyspepsia",
    "lightheadedness": "dizziness", "vertigo": "dizziness", "dizziness or lightheadedness": "dizziness", "pins and needles": "paresthesia",
    "paraesthesia": "paresthesia", "numbness and tingling": "paresthesia", "tingling sensation": "paresthesia", "brain fog": "memory impairment",
    "confusion": "memory impairment", "forgetfulness": "memory impairment", "difficulty concentrating": "memory impairment",
    "sleeplessness": "insomnia", "difficulty sleeping": "insomnia", "poor sleep": "sleep disturbance", "sleep problems": "sleep disturbance",
    "drowsiness": "somnolence", "sedation": "somnolence", "feeling tired": "fatigue", "tiredness": "fatigue", "lethargy": "fatigue",
    "malaise": "fatigue", "trembling": "tremor", "irregular heartbeat": "palpitations", "heart palpitations": "palpitations",
    "racing heart": "palpitations", "high blood pressure": "hypertension", "elevated blood pressure": "hypertension",
    "low blood pressure": "hypotension", "tachycardia": "increased heart rate", "fast heart rate": "increased heart rate", "skin rash": "rash",
    "hives": "urticaria", "itch": "pruritus", "itching": "pruritus", "skin itching": "pruritus", "swelling": "edema",
    "ankle swelling": "peripheral edema", "leg swelling": "peripheral edema", "water retention": "fluid retention", "puffiness": "edema",
    "hair loss": "alopecia", "loss of hair": "alopecia", "dry eyes": "xerophthalmia", "blurry vision": "blurred vision",
    "vision changes": "blurred vision", "shortness of breath": "dyspnea", "difficulty breathing": "dyspnea", "breathlessness": "dyspnea",
    "wheezing": "dyspnea", "runny nose": "rhinorrhea", "nasal discharge": "rhinorrhea", "muscle pain": "myalgia", "muscle ache": "myalgia",
    "muscle aches": "myalgia", "joint aches": "joint pain", "joint ache": "joint pain", "arthralgia": "joint pain", "bone pain": "pain",
    "body aches": "myalgia", "weight increase": "weight gain", "gaining weight": "weight gain", "weight decrease": "weight loss",
    "losing weight": "weight loss", "loss of appetite": "appetite loss", "decreased appetite": "appetite loss", "reduced appetite": "appetite loss",
    "increased thirst": "polydipsia", "excessive thirst": "polydipsia", "frequent urination": "polyuria", "excessive urination": "polyuria",
    "liver problems": "hepatotoxicity", "liver injury": "hepatotoxicity", "elevated liver enzymes": "hepatotoxicity",
    "kidney problems": "nephrotoxicity", "kidney injury": "nephrotoxicity", "renal failure": "renal impairment",
    "renal insufficiency": "renal impairment", "low white blood cells": "leukopenia", "low platelets": "thrombocytopenia",
    "bruising easily": "bruising", "unusual bleeding": "bleeding", "hot flush": "hot flashes", "hot flushes": "hot flashes",
    "night sweats": "sweating", "excessive sweating": "sweating", "feeling depressed": "depression", "mood changes": "depression",
    "anxiety attacks": "anxiety", "feeling anxious": "anxiety", "nervousness": "nervousness", "jitteriness": "nervousness",
    "restlessness": "nervousness", "fainting": "syncope", "fainting spells": "syncope", "dry mouth": "xerostomia", "xerostomia": "xerostomia",
    "mouth sores": "oral ulcers", "mouth ulcers": "stomatitis", "sore throat": "stomatitis", "ringing in ears": "tinnitus", "ear ringing": "tinnitus",
}

STOP_WORDS = [
    "randomised", "randomized", "placebo", "placebo-controlled", "double-blind", "participants", "patients", "subjects", "investigators", "study",
    "trial", "groups", "treatment", "control", "endpoint", "primary endpoint", "secondary endpoints", "weeks", "days", "months", "augmentation",
    "multicentre", "prospective", "retrospective", "phase", "orally", "assigned", "open-label", "adaptive-design",
]

TRIAL_STOP_WORDS = [
    "celecoxib", "minocycline", "gabapentin", "methotrexate", "erlotinib", "capecitabine", "oxaliplatin", "acetaminophen", "ibuprofen", "naproxen",
    "opioid", "opioids", "nsaids", "non-steroidal anti-inflammatory drugs", "anti-inflammatory", "antidepressant", "chemotherapy", "radiotherapy",
    "neoadjuvant therapy", "neoadjuvant treatment", "chemoradiotherapy", "capox", "scrt", "lcrt", "tme", "serrac", "larc", "dfs", "ccr", "mco",
    "grade 3-4", "anal verge", "anal preservation", "basal ganglion", "thalamus", "hematoma", "brain edema", "clinical complete response",
    "complete response", "pathological", "neoadjuvant", "randomized phase ii trial", "phase iia", "phase 2",
]

TRIAL_SYMPTOMS = [
    "hyperphagia", "hypersomnia", "fatigue", "weight gain", "leaden paralysis", "anhedonia", "insomnia", "cognitive impairment", "anorexia",
    "psychomotor retardation", "irritability", "hopelessness", "suicidal ideation", "postoperative pain", "chronic pain", "acute pain",
    "nociceptive pain", "neuroinflammation", "systemic inflammation", "inflammation",
]

TRIAL_OVERRIDES = [
    "chronic pain", "postoperative pain", "acute pain", "inflammation", "fatigue", "anorexia", "cognitive impairment", "insomnia", "weight gain",
    "hyperphagia", "hypersomnia",
]

CONDITIONS = {
    "major depressive disorder": "major_depressive_disorder", "mdd": "major_depressive_disorder", "inflammation": "inflammation", "pain": "pain",
    "acute myeloid leukemia": "acute_myeloid_leukemia", "aml": "acute_myeloid_leukemia", "colds": "common_cold", "allergies": "allergy",
    "hay fever": "allergic_rhinitis", "back pain": "back_pain", "acute kidney injury": "acute_kidney_injury",
    "intracerebral hemorrhage": "intracerebral_hemorrhage", "locally advanced rectal cancer": "locally_advanced_rectal_cancer",
    "head and neck cancer": "head_and_neck_cancer", "postoperative pain": "postoperative_pain", "post operative pain": "postoperative_pain",
    "neoadjuvant therapy": "neoadjuvant_therapy", "submental fat": "submental_fat", "surgery": "surgery", "unknown": "unknown",
}

MESH_EXCLUDED = [
    "humans", "animals", "male", "female", "adult", "aged", "cell line, tumor", "hl-60 cells", "cell survival", "signal transduction",
    "membrane potential, mitochondrial", "reactive oxygen species",
]

SIDE_EFFECT_PATTERNS = [
    r"\bcaus(?:es?|ed|ing)\b", r"\binduc(?:es?|ed|ing)\b", r"\bsid[e\s]+effect", r"\badverse\s+(?:event|reaction|effect)", r"\bdue to\b",
    r"\bafter (?:taking|using|treatment with|administration)\b", r"\bfollowing (?:administration|treatment|dose)\b", r"\bsecondary to\b",
    r"\btoxicit", r"\bcomplication", r"\bundesirable\b", r"\bdrug[\s\-]induced", r"\bmedication[\s\-]related", r"\btreatment[\s\-]related",
    r"\breaction to\b",
]

SYMPTOM_PATTERNS = [
    r"\bpresent(?:s|ed|ing)?\s+with\b", r"\bmanifest(?:s|ed|ation)?\b", r"\bsymptom(?:s|atic)?\b", r"\bsign(?:s)?\s+of\b",
    r"\bassociat(?:ed|ion)\s+with\s+(?:the\s+)?(?:disease|condition|disorder)\b", r"\bunderl(?:ying|ies)\b",
    r"\bclinical\s+(?:feature|presentation|finding)\b", r"\bpatholog", r"\bdiagnos(?:ed|is)\s+with\b", r"\bcomorbid",
    r"\bcourse of (?:the\s+)?disease\b",
]
