"""Math as HTML."""

from __future__ import annotations

import html
import re

# Commands without arguments.
SYMBOLS = {
    "alpha": "α", "beta": "β", "gamma": "γ", "delta": "δ", "epsilon": "ε", "zeta": "ζ", "eta": "η", "theta": "θ",
    "iota": "ι", "kappa": "κ", "lambda": "λ", "mu": "μ", "nu": "ν", "xi": "ξ", "pi": "π", "rho": "ρ",
    "sigma": "σ", "tau": "τ", "upsilon": "υ", "phi": "φ", "chi": "χ", "psi": "ψ", "omega": "ω", "Gamma": "Γ",
    "Delta": "Δ", "Theta": "Θ", "Lambda": "Λ", "Xi": "Ξ", "Pi": "Π", "Sigma": "Σ", "Phi": "Φ", "Psi": "Ψ",
    "Omega": "Ω", "rightarrow": "→", "leftarrow": "←", "leftrightarrow": "↔", "Rightarrow": "⇒", "Leftarrow": "⇐", "Leftrightarrow": "⇔", "to": "→",
    "gets": "←", "mapsto": "↦", "uparrow": "↑", "downarrow": "↓", "sum": "∑", "prod": "∏", "int": "∫", "oint": "∮",
    "bigcup": "⋃", "bigcap": "⋂", "coprod": "∐", "leq": "≤", "geq": "≥", "neq": "≠", "approx": "≈", "equiv": "≡",
    "sim": "∼", "simeq": "≃", "propto": "∝", "subset": "⊂", "supset": "⊃", "subseteq": "⊆", "supseteq": "⊇", "in": "∈",
    "notin": "∉", "ni": "∋", "infty": "∞", "partial": "∂", "nabla": "∇", "forall": "∀", "exists": "∃", "neg": "¬",
    "cdot": "·", "cdots": "⋯", "ldots": "…", "dots": "…", "times": "×", "div": "÷", "pm": "±", "mp": "∓",
    "circ": "∘", "bullet": "•", "star": "⋆", "emptyset": "∅", "varnothing": "∅", "ell": "ℓ", "hbar": "ℏ", "Re": "ℜ",
    "Im": "ℑ", "quad": "\u2003", "qquad": "\u2003\u2003", ",": "\u2009", ";": "\u2005", "!": "",
}
# Commands of one argument; {} is its HTML.
ONE = (
    {"sqrt": '<span class="math-sqrt">√<span class="math-sqrt-inner">{}</span></span>', "mathcal": '<span class="math-cal">{}</span>'}
    | dict.fromkeys(("text", "mathrm", "textrm"), '<span class="math-text">{}</span>')
    | dict.fromkeys(("textbf", "mathbf"), "<strong>{}</strong>")
    | dict.fromkeys(("textit", "mathit", "emph"), "<em>{}</em>")
    | {k: "{}" + mark for k, mark in (("hat", "\u0302"), ("bar", "\u0304"), ("tilde", "\u0303"), ("vec", "\u20d7"), ("dot", "\u0307"), ("ddot", "\u0308"))}
    | {k: f'<span class="math-{k}">{{}}</span>' for k in ("overline", "underline", "underbrace", "overbrace")}
    | {k: f'<span class="math-xarrow">{a}<sup class="math-xarrow-label">{{}}</sup></span>' for k, a in (("xrightarrow", "→"), ("xleftarrow", "←"))}
)
_DOUBLE = str.maketrans({chr(65 + i): chr(0x1D538 + i) for i in range(26)} | dict(zip("CHNPQRZ", "ℂℍℕℙℚℝℤ", strict=True)))
_TOKEN = re.compile(r"\\([A-Za-z]+|.)|([{}^_])|(\d+(?:\.\d+)?)|([A-Za-z]+)|(\S)", re.DOTALL)


def escape(s: str) -> str:
    return html.escape(s, quote=False).replace('"', "&#34;").replace("'", "&#39;")


def latex(src: str) -> str:
    """HTML of a formula. White space is dropped; a raised or lowered token that isn't braced is empty."""
    tokens = [m for m in _TOKEN.finditer(src)]
    at = 0

    def group() -> str | None:
        """The braced group that comes next."""
        nonlocal at
        if at < len(tokens) and tokens[at][2] == "{":
            at += 1
            inner = run("}")
            at += 1
            return inner
        return None

    def run(stop: str = "") -> str:
        nonlocal at
        out = []
        while at < len(tokens):
            m = tokens[at]
            if m[2] == "}" and stop:
                break
            at += 1
            if m[1]:
                out.append(command(m[1], m[0]))
            elif m[2] and m[2] in "^_":
                tag = "sup" if m[2] == "^" else "sub"
                inner = group()
                if inner is None:
                    inner, at = "", min(at + 1, len(tokens))
                out.append(f"<{tag}>{inner}</{tag}>")
            elif m[2] == "{":
                at -= 1
                out.append(group() or "")
            elif not m[2]:
                out.append(escape(m[0]))
        return "".join(out)

    def command(name: str, whole: str) -> str:
        if name == "frac":
            top = group()
            if top is not None:
                return f'<span class="math-frac"><span class="math-frac-num">{top}</span><span class="math-frac-den">{group() or ""}</span></span>'
        elif name == "mathbb" and (inner := group()) is not None:
            return inner.translate(_DOUBLE)
        elif name in ONE and (inner := group()) is not None:
            return ONE[name].format(inner)
        elif name not in SYMBOLS and (inner := group()) is not None:
            return f"{escape(whole)}({inner})"
        return SYMBOLS.get(name, escape(whole))

    return run()
