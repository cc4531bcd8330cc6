"""Rule-driven extraction."""

import pytest

from srcgraph.operators import extract as ex
from srcgraph.operators.rules import ALL_RULES, SDK_RULES


def in_order(df, column):
    return [r[column] for r in df.orderBy("ord", "rule_rank", "match_pos").collect()]


def test_script_routes(files):
    df = files(("a.ts", "app.get('/a', x); router.post( `/b`)\nmyapp.put(\"/c\")"), ("b.ts", "export async function GET(){}\nexport function  POST() {}"))
    assert in_order(ex.extract_routes(df), "route") == ["GET /a", "POST /b", "PUT /c", "GET", "POST"]


def test_python_and_go_routes(files):
    assert in_order(ex.extract_routes(files(("a.py", '@app.get("/x")\n@router.delete(\'/y\')\napp.get("/no")'))), "route") == ["GET /x", "DELETE /y"]
    assert in_order(ex.extract_routes(files(("a.go", 'r.GET("/g")\nhttp.HandleFunc("/h", f)'))), "route") == ["/g", "/h"]


def test_models(files):
    df = files(("a.ts", 'model A {\n@Entity("t") export class B {}\nclass C extends Model\nnew Schema({ new Schema('),)
    assert in_order(ex.extract_models(df), "model") == ["A", "B", "C", "MongooseSchema"]
    assert in_order(ex.extract_models(files(("a.py", "class U(Base):\nclass V(db.Model):\nclass W(Other):"))), "model") == ["U", "V"]
    assert ex.extract_models(files(("a.go", "model A {"))).count() == 0


@pytest.mark.parametrize("line", ["import x from 'a'", "import {b} from 'a'", "imports 'a'", "import {b}from\"a\""])
def test_imports_found(files, line):
    assert in_order(ex.extract_imports(files(("a.ts", line))), "package") == ["a"]


@pytest.mark.parametrize("line", [
    "require('a')", "import 'a'", "import * as p from 'a'", "import type { T } from 'a'", "import d, { e } from 'a'",
    "import x from './l'",
])
def test_imports_missed(files, line):
    assert ex.extract_imports(files(("a.ts", line))).count() == 0


def test_python_and_go_imports(files):
    assert in_order(ex.extract_imports(files(("a.py", "import os.path\nfrom x import y\n  import no"))), "package") == ["os.path", "x"]
    assert in_order(ex.extract_imports(files(("a.go", 'import "net/http"\nx := "a b"'))), "package") == ["net/http"]


def test_primary_language_rules_all_files(files):
    """Prisma files have no language of their own, yet the repository's rules read them."""
    df = files(("a.ts", ""), ("s.prisma", "model Z {"), ("x.py", 'class U(Base):'))
    assert in_order(ex.extract_models(df), "model") == ["Z"]
    assert in_order(ex.extract_models(df, "file"), "model") == ["U"]


def test_env_keys(files):
    df = files(("a.ts", "process.env.A + process.env.A; process.env.B"), ("b.py", 'os.environ["C"]; os.environ.get("D"); os.environ ("E")'), ("c.go", 'os.Getenv( "F")'))
    got = [(r["ord"], r["pos"], r["env_key"]) for r in ex.extract_env_vars(df).orderBy("ord", "pos").collect()]
    assert got == [(0, 0, "A"), (0, 1, "B"), (1, 0, "D"), (1, 1, "E"), (2, 0, "F")]


def test_one_scan_for_all_rules_equals_single_scans(files):
    df = files(("a.ts", "app.get('/a')\nmodel M {\nimport x from 'p'\nprocess.env.K"))
    together = {(r["kind"], r["rule_rank"], r["value"]) for r in ex.extract(df, ALL_RULES).collect()}
    assert together == {("route", 0, "GET /a"), ("model", 0, "M"), ("import", 0, "p"), ("env", 0, "K")}


def test_sdk_in_config(files):
    df = files(("package.json", "@aws-sdk/client process.env.AWS_KEY process.env.OTHER"))
    got = ex.detect_sdks(df).first()
    assert (got["name"], got["category"], got["sdk_package"], got["n_env_keys"]) == ("AWS", "cloud", "aws-sdk", 1)
    assert [r["env_key"] for r in ex.sdk_env_keys(df).collect()] == ["AWS_KEY"]


def test_sdk_config_wins_over_source(files):
    df = files(("a.ts", "import Stripe; redis"), ("package.json", "STRIPE"), ("b.md", "twilio"))
    got = {r["name"]: (r["sdk_package"], r["in_config"], r["ord"]) for r in ex.detect_sdks(df).collect()}
    assert got == {"Stripe": ("stripe", True, 1), "Redis": ("redis", False, 0)}


def test_env_keys_repeat_per_config_file(files):
    df = files(("a/package.json", "redis process.env.REDIS_URL"), ("b/package.json", "redis process.env.REDIS_URL"))
    assert ex.detect_sdks(df).first()["n_env_keys"] == 2
    assert ex.sdk_env_keys(df).count() == 2


SAMPLES = {
    "AWS": ("@aws-sdk/x", "aws-sdk", None), "Google Cloud": ("@google-cloud/x", "google-cloud", "GOOGLE_CLOUD_KEY"),
    "Azure": ("azure-x", "azure-", "AZURE_ID"), "Stripe": ("stripe", "stripe", "STRIPE_KEY"),
    "Email Service": ("mailgun", "nodemailer", "EMAIL_SERVICE_KEY"), "Twilio": ("Twilio", "twilio", "TWILIO_SID"),
    "Firebase": ("firebase", "firebase", "FIREBASE_ID"), "Supabase": ("supabase", "supabase", "SUPABASE_URL"),
    "Redis": ("redis", "ioredis", "REDIS_URL"), "Message Queue": ("rabbitmq", "amqplib", "MESSAGE_QUEUE_URL"),
    "OpenAI": ("openai", "openai", "OPENAI_KEY"), "Anthropic": ("@anthropic-ai/x", "anthropic-ai", "ANTHROPIC_KEY"),
    "Sentry": ("Sentry", "sentry", "SENTRY_DSN"), "Datadog": ("datadog", "datadog", "DATADOG_KEY"),
    "Auth Provider": ("passport", "auth0", "AUTH_PROVIDER_ID"), "Clerk": ("clerk", "clerk", "CLERK_KEY"),
}


def test_every_sdk_rule(rows):
    assert set(SAMPLES) == {name for name, _, _ in SDK_RULES}
    data = [(i, 0, "package.json", f"{word} process.env.{key or 'AWS_KEY'}") for i, (word, _, key) in enumerate(SAMPLES.values())]
    df = rows(data, "repo_id bigint, ord bigint, path string, content string")
    got = {(r["repo_id"], r["name"]): (r["sdk_package"], r["n_env_keys"]) for r in ex.detect_sdks(df).collect()}
    for i, (name, (_, package, _)) in enumerate(SAMPLES.items()):
        assert got[(i, name)] == (package, 1), name
