import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from assaykit.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session("4", memory="6g", partitions=4)
    yield session
    session.stop()


AS_OF = "2026-03-11"


@pytest.fixture
def pair():
    return base_pair()


def base_pair():
    """A sound resume/job pair as a plain dict; tests copy and change it."""
    return {
        "resume": {
            "contact": {"name": "Ada Example", "email": "ada@example.com", "phone": "415-555-1234", "location": "Town",
                        "linkedin": None, "portfolio": None},
            "education": [{"degree": "BSc", "institution": "State University", "graduation_date": "2018-05", "gpa": 3.8,
                           "coursework": []}],
            "experience": [
                {"company": "One", "title": "Software Engineer", "start_date": "2018-06", "end_date": "2021-06",
                 "responsibilities": ["Built services"], "achievements": ["Cut latency by half"]},
                {"company": "Two", "title": "Senior Software Engineer", "start_date": "2021-07", "end_date": "Present",
                 "responsibilities": ["Led a team"], "achievements": ["Moved the store"]},
            ],
            "skills": [
                {"name": "Python", "proficiency_level": "Expert", "years_used": 6.0},
                {"name": "FastAPI", "proficiency_level": "Advanced", "years_used": 3.0},
                {"name": "PostgreSQL", "proficiency_level": "Advanced", "years_used": 5.0},
                {"name": "Docker", "proficiency_level": "Intermediate", "years_used": 3.0},
                {"name": "Redis", "proficiency_level": "Intermediate", "years_used": 2.0},
            ],
            "summary": "Backend engineer who builds services in Python.",
            "metadata": {"trace_id": "r1", "generated_at": "2026-01-01", "prompt_template": "formal",
                         "fit_level": "Excellent", "writing_style": "formal"},
        },
        "job": {
            "company": {"name": "Acme", "industry": "Software", "size": "50-200 employees", "location": "Town"},
            "title": "Senior Python Developer",
            "description": "We look for a developer of backend services.",
            "requirements": {"required_skills": ["Python", "FastAPI", "PostgreSQL", "Docker", "Redis"],
                             "preferred_skills": ["Kubernetes"], "min_education": "BSc", "experience_years": 5,
                             "experience_level": "Senior"},
            "metadata": {"trace_id": "j1", "generated_at": "2026-01-01", "is_niche_role": False},
        },
        "metadata": {"pair_id": "pair-001", "created_at": "2026-01-01", "fit_level": "Excellent", "writing_style": "formal",
                     "correction_attempts": 0, "passed_validation": True, "validation_error_count": 0},
    }
