"""What shell commands, their answers and tool errors are, as column expressions.

Patterns are put together from lists of programs and phrases, and are written so that Java and RE2 read them alike.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from eventloom.functions.text import any_word

_STOP = r"(?:[^A-Za-z0-9_]|$)"


def _programs(table: dict[tuple[str, ...], tuple[str, ...]]) -> str:
    """A pattern for programs with one of their subcommands; programs without any stand alone."""
    words = lambda names: "|".join(n.replace(" ", r"\s+") for n in names)
    return "|".join(f"(?:{words(names)})" + (rf"\s+(?:{words(subs)})" if subs else "") for names, subs in table.items())


# Programs, with their subcommands, that only look at something and are run again and again for it.
_LOOKING = {
    ("git",): ("status", "diff", "log", "show", "branch", "fetch", "stash list", "worktree list"),
    ("sleep", "wait", "watch", "ps", "pgrep", "jobs", "top", "uptime", "date", "pwd", "whoami", "ls", "lsof", "make", "just"): (),
    ("npm", "pnpm", "yarn", "bun", "npm run", "pnpm run", "yarn run", "bun run"): ("test", "typecheck", "build", "lint", "check", "dev", "start"),
    ("vitest", "jest", "tsc", "eslint", "pytest", "mypy", "ruff", "playwright", "next build"): (),
    ("npx", "poetry run", "uv run"): ("vitest", "jest", "tsc", "eslint", "pytest", "mypy", "ruff", "playwright", "next build"),
    ("python -m", "python3 -m"): ("pytest", "unittest", "mypy"),
    ("cargo", "go"): ("test", "build", "check", "vet", "clippy"),
    ("gh",): ("run", "pr checks", "pr status", "pr view"),
    ("docker", "docker-compose", "kubectl", "docker compose"): ("ps", "logs", "get"),
}
LOOKING = rf"^(?:{_programs(_LOOKING)}){_STOP}|^curl\s.*(?:localhost|127\.0\.0\.1|0\.0\.0\.0){_STOP}"
WAITING = r"(?:^|[^A-Za-z0-9_])(?:sleep\s+[0-9]|(?:until|while)\s.*\sdo\s)|(?:^|[\s\"'=])(?:/private)?/tmp/|/var/folders/|\.log(?:[^A-Za-z0-9_]|$)"
# Programs that change the project.
_CHANGING = {
    ("git",): ("commit", "add", "checkout", "switch", "stash", "merge", "rebase", "reset", "pull", "cherry-pick", "restore", "rm", "mv", "apply", "am"),
    ("npm", "pnpm", "yarn", "bun"): ("install", "i", "add", "remove", "uninstall", "ci"),
    ("pip", "pip3"): ("install",),
    ("poetry",): ("install", "add", "lock", "remove"),
    ("uv",): ("add", "sync", "pip"),
    ("sed -i", "perl -pi", "rm", "mv", "cp", "mkdir", "touch", "tee", "patch", "ln"): (),
}
CHANGING = rf"(?:^|[;&|]\s*)(?:{_programs(_CHANGING)}){_STOP}|(?:^|\s)>>?\s*(?:[A-Za-z0-9_.~\"'$-]|/(?:[^d]|d[^e]|de[^v]))"
STASH_LIST = r"(?:^|[;&|]\s*)git\s+stash\s+list"

#: Changes of folder, sourced files and settings in front of a command.
PREFIX = r"^\s*(?:(?:cd|source)\s+\S+\s*(?:&&|;)\s*|[A-Za-z_][A-Za-z0-9_]*=\S*\s+)*"
#: Parts of a command that only limit how much it shows.
WINDOW = r"\|\s*(?:head|tail)(?:\s+-n)?\s*-?[0-9]+|\s--max-count[= ][0-9]+"
#: Times and durations, which change from run to run.
MOMENT = r"[0-9]{4}-[0-9]{2}-[0-9]{2}[T ][0-9]{2}:[0-9]{2}:[0-9]{2}(?:\.[0-9]+)?(?:Z|[+-][0-9]{2}:?[0-9]{2})?"
DURATION = r"([^A-Za-z0-9_.]|^)[0-9]+(?:\.[0-9]+)?\s?(?:ms|seconds|sec|s|m)([^A-Za-z0-9_]|$)"
ANSWER_CHARS = 4000

# Tools that are meant to be called again, and parts of names of tools that act on what cannot be seen here.
REPEATED_TOOLS = (
    "BashOutput", "TaskOutput", "KillShell", "KillBash", "TodoWrite", "TodoRead", "TaskList", "TaskGet", "TaskUpdate", "TaskCreate", "TaskStop",
    "ScheduleWakeup", "Monitor", "SendMessage", "write_stdin", "update_plan",
)
_UNSEEN = ("poll", "wait", "status", "browser", "computer", "playwright", "chrome", "screenshot", "navigate", "page", "click", "execute_sql", "query_logs")
UNSEEN_TOOLS = f"(?i){'|'.join(_UNSEEN)}"
WRITING_TOOLS = ("Edit", "Write", "MultiEdit", "NotebookEdit", "apply_patch")

# What the agent's platform says when it refuses or fails, which tells nothing of the project.
PLATFORM = any_word(
    "api error", "overloaded", "rate.?limit(?:ed|s)?", "(?:session|usage) limit", "temporarily unavailable", "terminated early",
    "context (?:window )?(?:limit|exceeded)", "request (?:timed out|timeout)", "protocol is blocked", "user (?:rejected|denied|declined|interrupted)",
    "permission (?:to use|denied by)", "requires? approval", "is isolated in the worktree", "refusing to run it", "permission for this action was denied",
    "invalid arguments for tool", "unknown tool", "no such tool available", "inputvalidationerror",
)
# Errors of a call that was written wrongly, and signs that an error is more than that.
FUMBLED = any_word(
    "enoent", "no such file or directory", "command not found", "no matches found", "did you mean", "unknown (?:option|flag|command)",
    "file (?:does not exist|not found)", "is a directory", "bad substitution", "syntax error near unexpected token", "unexpected eof while looking for",
    "parse error near",
)
GRAVE = any_word("traceback", "assertionerror", "tests? failed", r"[0-9]+ failing", "panic:")
#: Characters of an error that are read, and that it must have beside an exit code to say something.
ERROR_CHARS, SUBSTANCE = 400, 24
SCRATCH = r"(?:^|[;&|]\s*)(?:node|python3?|perl|ruby|deno)\s+(?:-\w+\s+)*-(?:e|c)(?:[^A-Za-z0-9_]|$)"
SCRATCH_FILE = r"(?:^|\s)\S*(?:/private/tmp/|/tmp/|/var/folders/|/scratchpad/)\S+"
REDIRECTED = r"(?:[0-9]?>>?|&>)\s*\S+"

# Names that many unrelated files have.
COMMON_NAMES = (
    "index", "main", "mod", "lib", "__init__", "readme", "package", "page", "layout", "route", "types", "util", "utils", "config", "setup", "test",
    "tests", "app", "server", "client", "constants", "helper", "helpers", "conftest", "setting", "settings", "model", "models", "schema",
)


def bare_command(command: Column) -> Column:
    """A command without what stands in front of it."""
    return F.trim(F.regexp_replace(command, PREFIX, ""))


def command_signature(command: Column) -> Column:
    """A command as it is compared: without prefix and window, single blanks, lower case."""
    return F.lower(F.trim(F.regexp_replace(F.regexp_replace(bare_command(command), WINDOW, " "), r"\s+", " ")))


def only_looks(command: Column) -> Column:
    bare = bare_command(command)
    return bare.rlike(LOOKING) | bare.rlike(WAITING)


def changes_project(command: Column) -> Column:
    bare = bare_command(command)
    return bare.rlike(CHANGING) & ~bare.rlike(STASH_LIST)


def plain_answer(output: Column) -> Column:
    """The start of an answer without times and durations; null if nothing is left."""
    masked = F.regexp_replace(F.substring(output, 1, ANSWER_CHARS), MOMENT, "T")
    masked = F.regexp_replace(masked, DURATION, "$1D$2")
    return F.nullif(F.trim(F.regexp_replace(masked, r"\s+", " ")), F.lit(""))


def of_platform(error: Column) -> Column:
    """Whether an error comes from the agent's platform."""
    return F.substring(error, 1, ERROR_CHARS).rlike(PLATFORM)


def fleeting(error: Column) -> Column:
    """Whether an error says nothing of the project: a wrong call, the platform, or next to no text; never one with a trace."""
    head = F.substring(error, 1, ERROR_CHARS)
    said = F.trim(F.regexp_replace(head, r"(?i)exit code [0-9]+", ""))
    return ~head.rlike(GRAVE) & (head.rlike(FUMBLED) | head.rlike(PLATFORM) | (F.length(said) < SUBSTANCE))


def is_scratch(command: Column) -> Column:
    """Whether a command is the agent's own trial: code on the line, or a file in a temporary folder that it runs."""
    return command.rlike(SCRATCH) | F.regexp_replace(command, REDIRECTED, " ").rlike(SCRATCH_FILE)


def path_parts(path: Column) -> Column:
    """Folder, base, stem and ending of a path; a dot that begins the base begins no ending."""
    base = F.regexp_extract(path, r"([^/]*)$", 1)
    return F.struct(
        F.regexp_extract(path, r"^(.*)/[^/]*$", 1).alias("folder"), base.alias("base"),
        F.regexp_replace(base, r"(.)\.[^.]*$", "$1").alias("stem"), F.regexp_extract(base, r".\.([^.]*)$", 1).alias("ending"),
    )


def near_stems(a: Column, b: Column) -> Column:
    """Whether two different stems of three characters or more are few edits apart: a quarter of the longer, at least one."""
    longest, shortest = F.greatest(F.length(a), F.length(b)), F.least(F.length(a), F.length(b))
    return (a != b) & (shortest >= 3) & (F.levenshtein(a, b) <= F.greatest(F.lit(1), F.floor(longest / 4)))
