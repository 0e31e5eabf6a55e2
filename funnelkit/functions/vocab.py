"""Event vocabulary of the analytics log.

Fixed values: event names, call-to-action names and platform names that the
analyses match on. They are kept in one place so a deployment can remap them
to its own log without touching operator code.
"""

# --- fixed values: client event names ---------------------------------------
PURCHASE_CLICK = "purchase_click"
PRE_PURCHASE_CLICK = "pre_purchase_click"
OFFER_IMPRESSION = "offer_impression"
NATIVE_POPUP = "native_popup"
PURCHASE_SUCCESSFUL = "purchase_successful"
REWARDS = "rewards"
VERIFY_REQUEST = "verify_request"
VERIFY_APPROVAL = "verify_approval"
CONFIG_LOADED = "config_loaded"
PROMO_IMPRESSION = "promo_impression"

# --- fixed values: call-to-action names on pre-purchase clicks ----------------
CTA_CONTINUE = "continue"
CTA_SELECT_DIRECT = "select_direct"
CTA_SELECT_STORE = "select_store"
CTA_PAY = "pay"

# --- fixed values: server (payment service) event names -----------------------
WF_IMPRESSION = "wf_impression"
WF_ADD_CARD = "wf_add_card"
WF_CHECKOUT_CLICK = "wf_checkout_click"
WF_SUCCESS = "wf_success"
WH_SUCCESS = "wh_success"

# --- fixed values: payment platforms -------------------------------------------
DIRECT = "direct"
APPLE = "apple"
GOOGLEPLAY = "googleplay"
STORES = (APPLE, GOOGLEPLAY)
PLATFORMS = (DIRECT, APPLE, GOOGLEPLAY)

# --- fixed values: experiment segment tags (matched with LIKE, '_' is a wildcard)
TEST_TAG = "%LiveOpsData.exp_test%"
CONTROL_TAG = "%LiveOpsData.exp_control%"
TEST = "test"
CONTROL = "control"
