"""Type of an invoice row: each type adds up weighted signals, and the best counts if it is positive and clearly ahead."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import and_

from pyspark.sql import Column
from pyspark.sql import functions as F

from docledger.functions.text import bounded, met

# Words of each signal. Phrases that hold one of a signal's other words add nothing and are left out.
PRODUCT = ("product", "item", "sku", "code", "description", "article", "goods", "merchandise")
UNIT = (
    "kg", "g", "l", "ml", "pcs", "piece", "unit", "box", "pack", "carton", "bottle", "jar", "bag", "can", "tube", "roll", "sheet", "set",
    "pair", "dozen",
)
NOT_PRODUCT = (
    "total", "subtotal", "vat", "tax", "payment", "due", "amount", "footer", "header", "banking", "terms", "conditions", "thank you", "page",
    "invoice",
)
DELIVERY = ("delivery", "shipping", "postage", "freight", "transport", "shipment", "courier", "logistics", "handling", "packaging")
DELIVERED = ("delivered", "shipped", "sent", "arrived", "received", "dispatched", "transit", "on way", "on delivery")
DISCOUNT = (
    "discount", "reduction", "off", "sale", "special", "promo", "promotion", "voucher", "coupon", "rebate", "cashback", "credit", "allowance",
    "write-down", "adjustment", "revised",
)
DISCOUNTED = (
    "percent", "percentage", "off", "discounted", "reduced", "lowered", "cut", "saved", "free", "bonus", "gift", "complimentary", "compliment",
)
TAX = ("vat", "tax", "gst", "taxable")
TAX_AMOUNT = ("tax amount", "tax inclusive", "tax exclusive")
SUBTOTAL = (
    "subtotal", "sub total", "before tax", "before vat", "before discount", "before total", "before final", "before grand", "before amount",
    "before sum",
)
TOTAL = ("total", "amount due", "amount payable")
PAYMENT = ("payment", "paid", "received", "collected")
TENDER = (
    "cash", "credit card", "debit card", "bank transfer", "eft", "wire transfer", "direct debit", "paypal", "stripe", "apple pay", "google pay",
    "venmo", "zelle", "money order", "check", "cheque", "invoice",
)
RETURN = ("return", "returned", "returning")
# Words that close or surround an invoice, those of documents, parties and addresses.
FOOTER = (
    "footer", "page", "total", "amount", "payment", "due", "balance", "remaining", "outstanding", "paid", "settled", "cleared", "final",
    "complete", "done", "finished", "processed", "approved", "accepted", "confirmed", "authorized", "signed", "signature", "date", "time",
    "company", "address", "contact", "phone", "email", "website", "terms", "conditions", "disclaimer", "copyright", "license", "agreement",
    "contract", "policy", "procedure", "process", "workflow", "flow", "sequence", "order", "reference", "number", "id", "identifier", "code",
    "key", "token", "credential", "password", "login", "account", "profile", "user", "member", "client", "customer", "supplier", "vendor",
    "provider", "partner", "affiliate", "associate", "collaborator", "contributor", "developer", "engineer", "technician", "specialist",
    "expert", "consultant", "advisor", "manager", "supervisor", "leader", "head", "director", "executive", "officer", "administrator", "admin",
    "operator", "staff", "employee", "worker", "personnel", "team", "group", "department", "division", "section", "unit", "facility",
    "location", "site", "place", "area", "zone", "region", "district", "state", "province", "territory", "country",
)
NUMBER = r"[0-9]+(\.[0-9]+)?"

#: Further words of footers, for those who keep a longer list.
MORE_FOOTER: tuple[str, ...] = ()

#: Types in the order that breaks ties.
TYPES = (
    "product", "delivery", "discount", "vat", "subtotal", "total", "payment", "credit", "return", "service_charge", "header", "footer", "unknown",
)
#: Least distance to the second type.
LEAST_MARGIN = 0.5


def patterns(more_footer: tuple[str, ...] = MORE_FOOTER, bounded: Callable[..., str] = bounded) -> dict[str, str]:
    """Pattern of each signal that is looked for in a row, in lower case; ``bounded`` makes those of words."""
    vat_rate = r"(^|[^a-z0-9_])(vat|tax)[^a-z0-9_].*?[0-9]+(\.[0-9]+)?%"
    words = {
        "product": PRODUCT, "unit": UNIT, "product_code": (r"0000000000[0-9]+",), "number": (NUMBER,), "price": ("unit", "price", "cost"),
        "line": ("total", "amount", "line"), "not_product": NOT_PRODUCT, "delivery": DELIVERY, "delivered": DELIVERED, "discount": DISCOUNT,
        "discounted": DISCOUNTED, "tax": TAX, "tax_amount": TAX_AMOUNT, "zero": (r"0\.00", r"0\.0", "0"), "subtotal": SUBTOTAL,
        "sub": ("sub",), "total": TOTAL, "invoice_sum": ("invoice amount", "invoice sum"), "payment": PAYMENT, "tender": TENDER,
        "credit": ("credit",), "return": RETURN, "service": ("service",), "service_charge": ("service", "admin", "handling"),
        "invoice": ("invoice",), "footer": (*FOOTER, *more_footer), "summed": ("total", "subtotal", "vat", "tax"), "minus": ("minus",),
    }
    found = {name: bounded(*terms) for name, terms in words.items()}
    return found | {"vat_rate": vat_rate, "minus": found["minus"] + "|[a-z0-9_]-[a-z0-9_]"}


#: Signals that are told, by name.
TOLD = {
    "product": "product", "unit": "unit", "product code": "product_code", "delivery": "delivery", "delivered": "delivered",
    "discount": "discount", "discounted": "discounted", "tax": "tax", "zero": "zero", "subtotal": "subtotal", "sub": "sub", "payment": "payment",
    "tender": "tender", "credit": "credit", "return": "return", "service": "service", "invoice": "invoice", "footer": "footer",
}
#: Weights: of each type's signals; ``structure`` is a product's words, unit and number, ``valid`` quantity times price as total.
WEIGHTS = {
    "product": (("product", 3), ("unit", 4), ("product_code", 2), ("counted", 4), ("priced", 4), ("summed_line", 4), ("valid", 6), ("not_product", -8), ("footer", -10)),
    "delivery": (("delivery", 8), ("structure", -4)),
    "discount": (("discount", 8), ("minus", 2)),
    "vat": (("tax", 8), ("vat_rate", 3), ("tax_amount", 4), ("structure", -8), ("valid", -8)),
    "subtotal": (("subtotal", 8), ("structure", -8)),
    "total": (("total", 8), ("subtotal", -4), ("structure", -8)),
    "payment": (("payment", 8), ("structure", -8)),
    "credit": (("credit", 8), ("minus", 2)),
    "return": (("return", 8),),
    "service_charge": (("service_charge", 8),),
    "header": (("invoice", 8), ("unstructured", 3)),
    "footer": (("footer", 8), ("structure", -8)),
    "unknown": (),
}
#: Signals that others make up.
JOINT = {
    "counted": ("number", "unit"), "priced": ("number", "price"), "summed_line": ("number", "line"), "structure": ("product", "unit", "number"),
}
#: What a type's confidence is multiplied by where the signal speaks against it.
CONFLICTS = {"product": ("summed", 0.7), "vat": ("structure", 0.8)}
TOLERANCE = 0.01


def _bind(x: Column, f: Callable[[Column], Column]) -> Column:
    return F.get(F.transform(F.array(x), f), F.lit(0))


def classify(
    text: Column, quantity: Column, unit_price: Column, total: Column, more_footer: tuple[str, ...] = MORE_FOOTER, validated: Column | None = None
) -> Column:
    """Struct of type, confidence (0 to 1), margin, second type, told signals and whether a signal speaks against the type.

    A null text counts as empty; numbers that are null prove nothing; ``validated`` says that the line was validated
    before, which adds three for a product. Equal scores: the type that stands first in TYPES.
    """
    valid = F.coalesce(F.abs(quantity * unit_price - total) < TOLERANCE, F.lit(False))
    extra = F.when(F.coalesce(validated, F.lit(False)), 3).otherwise(0) if validated is not None else F.lit(0)
    # lambdas compute what they are given once, and the text in lower case is looked at by every signal
    signals = lambda low: F.struct(
        *(low.rlike(p).alias(name) for name, p in patterns(more_footer, met).items()), valid.alias("valid"), extra.cast("double").alias("extra")
    )

    def told(s: Column) -> Column:
        of_total = F.when(s["total"] | s["invoice_sum"], "total")
        names = [F.when(s[signal], F.lit(name)) for name, signal in TOLD.items()]
        return F.array_compact(F.array(*names, of_total))

    def joined(s: Column) -> Callable[[str], Column]:
        def holds(name: str) -> Column:
            if name == "unstructured":
                return ~holds("structure")
            return reduce(and_, (s[n] for n in JOINT[name])) if name in JOINT else s[name]

        return holds

    def scored(s: Column) -> Column:
        holds = joined(s)

        def score(kind: str) -> Column:
            total = sum((F.when(holds(name), float(w)).otherwise(0.0) for name, w in WEIGHTS[kind]), F.lit(0.0))
            return total + s["extra"] if kind == "product" else total

        rows = [F.struct(score(k).alias("score"), F.lit(-i).alias("order"), F.lit(k).alias("type")) for i, k in enumerate(TYPES)]
        against = F.create_map(*(v for k, (name, _) in CONFLICTS.items() for v in (F.lit(k), holds(name))))
        return F.struct(F.reverse(F.array_sort(F.array(*rows))).alias("ranked"), told(s).alias("told"), against.alias("against"))

    def decided(r: Column) -> Column:
        first, second = F.get(r["ranked"], F.lit(0)), F.get(r["ranked"], F.lit(1))
        margin = first["score"] - second["score"]
        known = (first["score"] > 0) & (margin >= LEAST_MARGIN)
        against = known & F.coalesce(r["against"][first["type"]], F.lit(False))
        factor = F.create_map(*(F.lit(v) for k, (_, by) in CONFLICTS.items() for v in (k, by)))[first["type"]]
        sure = F.least(F.lit(1.0), first["score"] / 20 + margin / 10) * F.when(against, factor).otherwise(1.0)
        return F.struct(
            F.when(known, first["type"]).otherwise("unknown").alias("type"),
            F.when(known, sure).otherwise(0.0).alias("confidence"),
            margin.alias("margin"),
            second["type"].alias("second"),
            r["told"].alias("signals"),
            against.alias("conflict"),
        )

    return _bind(_bind(_bind(F.lower(F.coalesce(text, F.lit(""))), signals), scored), decided)


def requested(asked: Column, found: Column) -> Column:
    """The type asked for, unless it is null, empty or ``unknown``."""
    wish = F.lower(F.trim(asked))
    return F.when(wish.isNull() | wish.isin("", "unknown"), found).otherwise(wish)


def is_product(kind: Column) -> Column:
    return F.coalesce(F.lower(F.trim(kind)) == "product", F.lit(False))


def sql(source: str, text: str, quantity: str, unit_price: str, total: str) -> str:
    """The same for DuckDB, as common table expressions that end in ``classified``."""
    flags = ", ".join(f"regexp_matches({text}, '{p}') AS f_{name}" for name, p in patterns().items())
    joint = ", ".join(f"({' AND '.join(f'f_{n}' for n in parts)}) AS f_{name}" for name, parts in JOINT.items())
    scores = ", ".join(
        "(" + " + ".join(["0.0::DOUBLE", *(f"{w} * {'(NOT f_structure)' if name == 'unstructured' else f'f_{name}'}::INT" for name, w in parts)]) + f") AS s_{kind}"
        for kind, parts in WEIGHTS.items()
    )
    kinds = ", ".join(f"{{'score': s_{k}, 'o': {-i}, 'type': '{k}'}}" for i, k in enumerate(TYPES))
    told = ", ".join([*(f"CASE WHEN f_{s} THEN '{n}' END" for n, s in TOLD.items()), "CASE WHEN f_total OR f_invoice_sum THEN 'total' END"])
    against = " OR ".join(f"(r[1].type = '{k}' AND f_{name})" for k, (name, _) in CONFLICTS.items())
    factor = " ".join(f"WHEN r[1].type = '{k}' AND f_{name} THEN {by}" for k, (name, by) in CONFLICTS.items())
    return f"""flags AS (SELECT *, {flags}, coalesce(abs({quantity} * {unit_price} - {total}) < {TOLERANCE}, false) AS f_valid FROM {source}),
    joint AS (SELECT *, {joint} FROM flags), scores AS (SELECT *, {scores} FROM joint), ranked AS (SELECT *, list_sort([{kinds}], 'DESC') AS r FROM scores),
    known AS (SELECT *, r[1].score > 0 AND r[1].score - r[2].score >= {LEAST_MARGIN} AS known FROM ranked),
    classified AS (SELECT *, CASE WHEN known THEN r[1].type ELSE 'unknown' END AS type,
      CASE WHEN known THEN least(1.0::DOUBLE, r[1].score / 20 + (r[1].score - r[2].score) / 10) * (CASE {factor} ELSE 1.0 END)::DOUBLE ELSE 0 END AS confidence,
      r[1].score - r[2].score AS margin, r[2].type AS second, array_to_string(list_filter([{told}], lambda x: x IS NOT NULL), ', ') AS signals, known AND ({against}) AS conflict FROM known)"""
