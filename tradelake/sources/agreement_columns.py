"""The agreement file's headers."""

# Header of the file (blanks collapsed) and column name.
HEADERS = {
    "No.": "aptiad_no",
    "Title": "title",
    "Members": "members_raw",
    "Status": "status",
    "Scope": "scope",
    "Type": "agreement_type",
    "Upgraded": "upgraded",
    "Upgraded Status": "upgraded_status",
    "Year of Signature (Upgraded)": "year_signature_upgraded",
    "Year of Enforcement/Termination (Upgraded)": "year_enforcement_upgraded",
    "Trade in Goods": "trade_in_goods",
    "Year of Signature (Goods)": "year_signature_goods",
    "Year of Enforcement/ Termination (Goods)": "year_enforcement_goods",
    "WTO Notification (Goods)": "wto_notification_goods",
    "WTO Notification Link": "wto_notification_link_goods",
    "WTO Notification Year (Goods)": "wto_notification_year_goods",
    "WTO Consideration Process (Goods)": "wto_consideration_goods",
    "SPS/TBT": "sps_tbt",
    "Anti-Dumping Duty": "anti_dumping_duty",
    "Safeguard": "safeguard",
    "Trade in Services": "trade_in_services",
    "Year of Signature (Services)": "year_signature_services",
    "Year of Enforcement/ Termination (Services)": "year_enforcement_services",
    "WTO Notification (Services)": "wto_notification_services",
    "WTO Notification Year (Services)": "wto_notification_year_services",
    "WTO Consideration Process (Services)": "wto_consideration_services",
    "Liberalization Approach (Services)": "liberalization_services",
    "Investment": "investment",
    "Year of Signature (Investment)": "year_signature_investment",
    "Year of Enforcement/ Termination (Investment)": "year_enforcement_investment",
    "Liberatlization approach (Investment)": "liberalization_investment",
    "BIT (Source UNCTAD)": "bit_unctad",
    "Trade Facilitation & Customs Cooperation": "trade_facilitation",
    "Government Procurement": "gov_procurement",
    "Competition Policy": "competition_policy",
    "Intellectual Property": "intellectual_property",
    "Dispute Settlement": "dispute_settlement",
    "Temporary Movement of Natural Persons": "movement_natural_persons",
    "Sustainable Development Related Provisions": "sd_related",
    "Sustainable Development by Concept": "sd_by_concept",
    "Labour protection": "labour",
    "Human Rights": "human_rights",
    "Gender": "gender",
    "Health": "health",
    "Environment": "environment",
    "SMEs": "smes",
    "Technical Cooperation": "technical_cooperation",
    "Transparency": "transparency",
    "Financial Services": "financial_services",
    "Telecommunications": "telecommunications",
    "E-commerce": "ecommerce",
    "Online Consumer Protection (in E-commerce Chapter)": "ecommerce_consumer_protection",
    "Personal Data Protection (in E-commerce Chapter)": "ecommerce_personal_data",
    "Data flows (in E-commerce Chapter)": "ecommerce_data_flows",
    "Link to website": "link_website",
}
#: The yes/no columns of the file that are provisions of an agreement.
PROVISIONS = [
    "sps_tbt", "anti_dumping_duty", "safeguard", "trade_facilitation", "gov_procurement", "competition_policy", "intellectual_property", "dispute_settlement",
    "movement_natural_persons", "sd_related", "sd_by_concept", "labour", "human_rights", "gender", "health", "environment", "smes", "technical_cooperation", "transparency",
    "financial_services", "telecommunications", "ecommerce", "ecommerce_consumer_protection", "ecommerce_personal_data", "ecommerce_data_flows",
]
#: Columns that have another name once they are typed.
RENAMED = {
    "title": "fta_name",
    "members_raw": "member_countries",
    "upgraded": "is_upgraded",
    "trade_in_goods": "has_trade_goods",
    "trade_in_services": "has_trade_services",
    "investment": "has_investment",
    "wto_notification_link_goods": "wto_notification_link",
    "link_website": "source_link",
    "anti_dumping_duty": "provision_anti_dumping",
}
YES_NO = ["upgraded", "trade_in_goods", "trade_in_services", "investment", *PROVISIONS]
