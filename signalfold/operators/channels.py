"""What alert channels send: texts and requests of webhook, chat and mail, over a transport that the caller gives."""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping
from email.message import EmailMessage
from urllib.request import Request, urlopen

from signalfold.operators.alert_state import Alert, Notifier

#: Where chat messages are posted, and seconds that a channel may take (fixed values).
CHAT_URL, TIMEOUT = "https://slack.com/api/chat.postMessage", 10

#: post(url, headers, body) -> the response's text; raises where it is not a success.
Post = Callable[[str, Mapping[str, str], bytes], str]
SendMail = Callable[[EmailMessage], None]


def summary(alert: Alert) -> str:
    """The one-line text of an alert (its words are fixed)."""
    group = "" if alert.group_key is None else f" [{alert.group_key}]"
    return f"[{alert.state.upper()}] {alert.rule_name} ({alert.severity}){group} — {alert.description} (valeur={alert.value:.4f}, seuil={alert.threshold:.4f})"


def payload(alert: Alert) -> dict:
    return {
        "rule": alert.rule_name, "severity": alert.severity, "state": alert.state.upper(), "value": alert.value, "threshold": alert.threshold,
        "description": alert.description, "group_key": alert.group_key, "summary": summary(alert)}


def post(url: str, headers: Mapping[str, str], body: bytes) -> str:
    with urlopen(Request(url, body, dict(headers)), timeout=TIMEOUT) as r:
        return r.read().decode("utf-8", "replace")


def _json(document: dict) -> bytes:
    return json.dumps(document, ensure_ascii=False).encode()


def webhook(action: dict, send: Post = post) -> Notifier:
    headers = {"Content-Type": "application/json"} | dict(action.get("headers") or {})

    def notify(alert: Alert) -> bool:
        send(action["url"], headers, _json(payload(alert)))
        return True

    return notify


def chat(action: dict, token: str, channel: str, send: Post = post) -> Notifier:
    """The service answers 200 even to a refusal, which its document tells."""
    headers = {"Content-Type": "application/json; charset=utf-8", "Authorization": f"Bearer {token}"}

    def notify(alert: Alert) -> bool:
        return bool(json.loads(send(CHAT_URL, headers, _json({"channel": action.get("channel") or channel, "text": summary(alert)}))).get("ok"))

    return notify


def mail(action: dict, sender: str, to: list[str], send: SendMail, subject: str = "[alert]") -> Notifier:
    def notify(alert: Alert) -> bool:
        m = EmailMessage()
        m["From"], m["To"], m["Subject"] = sender, ", ".join(action.get("to") or to), f"{subject} {summary(alert)}"
        m.set_content(summary(alert))
        send(m)
        return True

    return notify
