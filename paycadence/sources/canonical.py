"""Names and value sets of the canonical frames.

========  ==============================================================
frame     columns
========  ==============================================================
payments  customer_id, lease_id, je_id, account, method, cents bigint,
          fee decimal(18,4), created date
returns   created date, fee decimal(18,4)
leases    lease_id, frequency, deleted boolean,
          tenants array<struct<tenant>>
daily     lease_id, snapshot_date date, status, account, frequency,
          merchant_flag int, account_first_invoice date
tenants   tenant_id, portal struct<accepted_at, last_sent_at>
entries   entry_id, account, type, deleted boolean, due string,
          charges array<struct<linked, cents bigint>>
accounts  account, name, segment, is_test boolean
events    event, ts, sent_to_id, account, env, is_test boolean, source,
          sent_to_type
========  ==============================================================

Amounts are whole cents in a bigint: sums stay exact and need no decimal
arithmetic per row. Reports turn them into double currency units at the end.
Key columns may have any type as long as both sides of a join agree; cast them
once in the adapter, never in an operator.
"""

from __future__ import annotations

# Fixed values.
CARD, ACH, CASH = "charge", "payment", "cash payment"
ALL_METHODS = (CARD, ACH, CASH)
CARD_OR_ACH = (CARD, ACH)
FREQUENCIES = ("Monthly", "Every2Weeks", "Weekly", "Daily")
ACTIVE = "ACTIVE"
PAYMENT_ENTRY = "leasePayment"
INVITE, PAGE_VIEW = "invitation_sent", "invitation_pageview"
