"""Extraction rules as data. A rule set is plain text; `extract` turns it into column expressions."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Rule:
    """One pattern.

    family  language family whose files it reads, None for every file
    guards  literal texts, one of which every match contains: a cheap test before the regex
    value   how groups become the finding: "1" (group 1), "upper1 2" (method and path), or "=text"
            for a rule that yields one fixed finding however often it matches
    """

    kind: str
    name: str
    family: str | None
    pattern: str
    guards: tuple[str, ...]
    value: str = "1"


# What counts as a route, model, import or environment key in each language.
ROUTE_RULES = (
    Rule("route", "express", "script",
         r"""(?:app|router)\.(get|post|put|delete|patch)\s*\(\s*['"`]([^'"`]+)['"`]""",
         ("app.", "router."), "upper1 2"),
    Rule("route", "handler_export", "script",
         r"export\s+(?:async\s+)?function\s+(GET|POST|PUT|DELETE|PATCH)", ("export",)),
    Rule("route", "decorator", "python",
         r"""@(?:app|router)\.(get|post|put|delete|patch)\s*\(\s*['"]([^'"]+)['"]""",
         ("@app.", "@router."), "upper1 2"),
    Rule("route", "handle_func", "go",
         r"""(?:http\.HandleFunc|r\.(?:GET|POST|PUT|DELETE|PATCH))\s*\(\s*"([^"]+)\"""",
         ("http.HandleFunc", "r.GET", "r.POST", "r.PUT", "r.DELETE", "r.PATCH")),
)
MODEL_RULES = (
    Rule("model", "prisma", "script", r"model\s+(\w+)\s*\{", ("model",)),
    Rule("model", "typeorm", "script", r"@Entity\([^)]*\)\s*(?:export\s+)?class\s+(\w+)", ("@Entity(",)),
    Rule("model", "sequelize", "script", r"class\s+(\w+)\s+extends\s+Model", ("Model",)),
    Rule("model", "mongoose", "script", r"new\s+Schema\s*\(", ("Schema",), "=MongooseSchema"),
    Rule("model", "sqlalchemy", "python", r"class\s+(\w+)\s*\(\s*(?:Base|db\.Model|Model)\s*\)", ("class",)),
)
IMPORT_RULES = (
    Rule("import", "es_import", "script",
         r"""(?:import|require)\s*(?:\{[^}]*\}|[\w*]+)\s*(?:from\s*)?['"`]([^'"`]+)['"`]""",
         ("import", "require")),
    Rule("import", "py_import", "python", r"(?m)^(?:import|from)\s+([\w.]+)", ("import", "from")),
    Rule("import", "go_import", "go", r'"([\w./]+)"', ('"',)),
)
ENV_RULES = (
    Rule("env", "node", None, r"process\.env\.(\w+)", ("process.env.",)),
    Rule("env", "python", None, r"""os\.environ(?:\.get)?\s*\(\s*['"](\w+)['"]""", ("os.environ",)),
    Rule("env", "go", None, r"""os\.Getenv\s*\(\s*"(\w+)\"""", ("os.Getenv",)),
)
ALL_RULES = ROUTE_RULES + MODEL_RULES + IMPORT_RULES + ENV_RULES

# External services, the texts that reveal them (any case), and their category.
SDK_RULES = (
    ("AWS", "cloud", "aws-sdk|@aws-sdk"),
    ("Google Cloud", "cloud", "@google-cloud"),
    ("Azure", "cloud", "azure-"),
    ("Stripe", "payment", "stripe"),
    ("Email Service", "email", "nodemailer|sendgrid|@sendgrid|mailgun|resend"),
    ("Twilio", "other", "twilio"),
    ("Firebase", "cloud", "firebase|@firebase"),
    ("Supabase", "cloud", "supabase"),
    ("Redis", "queue", "ioredis|redis"),
    ("Message Queue", "queue", "amqplib|rabbitmq|bull|bullmq"),
    ("OpenAI", "other", "openai"),
    ("Anthropic", "other", "@anthropic-ai"),
    ("Sentry", "monitoring", "sentry"),
    ("Datadog", "monitoring", "datadog"),
    ("Auth Provider", "auth", "auth0|passport|@auth0"),
    ("Clerk", "auth", "clerk"),
)
INFRA_CATEGORIES = ("queue", "cloud")


def sdk_package(pattern: str) -> str:
    """Package name for a service seen in a config file: the first text, without `@`."""
    return pattern.split("|")[0].replace("@", "")


def env_needle(name: str) -> str:
    """What an environment key must contain to belong to a service."""
    return name.upper().replace(" ", "_", 1)
