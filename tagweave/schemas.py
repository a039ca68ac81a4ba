"""Fixed schemas of the landed documents."""

# Field names and types of the landed JSON documents.
_LISTING_STRUCT = (
    "struct<id:string,name:string,area:struct<name:string>,"
    "snippet:struct<requirement:string,responsibility:string>,"
    "work_format:array<struct<id:string,name:string>>,"
    "employer:struct<id:string,name:string>,experience:struct<name:string>,"
    "salary:struct<`from`:bigint,`to`:bigint,currency:string>,"
    "alternate_url:string,published_at:string>"
)
LISTING_PAGE = f"keyword string, page int, pages int, items array<{_LISTING_STRUCT}>"
ITEM_DETAIL = "id string, key_skills string"
EMPLOYER = "id string, industries array<struct<name:string>>"

RECOMMENDATION_TEXTS = (
    "nearest_position",
    "nearest_position_reason",
    "recommended_position",
    "recommended_position_reason",
    "skills_gap",
    "plan_1_2_years",
)
RECOMMENDATION_LISTS = ("recommended_courses", "current_vacancies")
